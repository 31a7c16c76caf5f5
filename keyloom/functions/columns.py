"""The text rules as columns: native ones inside code generation, exact ones as Arrow UDFs.

Native NFKC covers the full-width forms (U+FF01 to U+FF5E and U+3000), which is what
exports differ in; the exact forms also fold compatibility characters and full case.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import ALIAS_SEPARATORS, DEFAULT, ID_PREFIX, ID_SHAPE, ILLEGAL_XML, TRAILING_NOTE, Lexicon
from . import text as T

FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
SPACE = r"(?U)[\s\x1c-\x1f]"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def half_width(c: Column) -> Column:
    return F.translate(text_of(c), FULL, HALF)


def norm_text(c: Column) -> Column:
    return F.regexp_replace(half_width(c), rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(half_width(c), rf"{SPACE}+", "")


def strip_note(c: Column) -> Column:
    return F.regexp_replace(c, TRAILING_NOTE, "")


def strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + ID_PREFIX, "")


def norm_key(c: Column, kind: str) -> Column:
    bare = strip_note(squeeze(c))
    as_id = F.lower(strip_prefix(bare))
    if kind == "auto":
        return F.when(bare.rlike(ID_SHAPE), as_id).otherwise(bare)
    return as_id if kind == "id" else bare


#: White space that Python's ``strip`` and ``split`` know among ASCII characters.
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def _bare(values: pa.Array) -> pa.Array:
    """``squeeze`` without the trailing note, of ASCII texts."""
    return pc.replace_substring_regex(pc.replace_substring_regex(values, f"[{ASCII_SPACE}]+", ""), TRAILING_NOTE, "", max_replacements=1)


def _ascii_key(values: pa.Array, kind: str) -> pa.Array:
    bare = _bare(values)
    if kind == "name":
        return bare
    as_id = pc.ascii_lower(pc.replace_substring_regex(bare, "(?i)" + ID_PREFIX, "", max_replacements=1))
    return as_id if kind == "id" else pc.if_else(pc.match_substring_regex(bare, ID_SHAPE), as_id, bare)


def _exact(rule, of_ascii) -> object:
    """An Arrow UDF (one string column in and out): ASCII texts in Arrow's kernels, each distinct other text by the Python rule."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        values = pc.fill_null(values.cast(pa.string()), "")
        plain = pc.string_is_ascii(values)
        if pc.all(plain).as_py() is not False:
            return of_ascii(values)
        other = pc.filter(values, pc.invert(plain)).dictionary_encode()
        ruled = pa.array([rule(x) for x in other.dictionary.to_pylist()], pa.string()).take(other.indices)
        return pc.replace_with_mask(of_ascii(pc.if_else(plain, values, "")), pc.invert(plain), ruled)

    return run


def norm_text_exact(c: Column) -> Column:
    return _exact(T.norm_text, lambda v: pc.utf8_trim(v, ASCII_SPACE))(c)


def squeeze_exact(c: Column) -> Column:
    return _exact(T.squeeze, lambda v: pc.replace_substring_regex(v, f"[{ASCII_SPACE}]+", ""))(c)


def norm_key_exact(c: Column, kind: str) -> Column:
    return _exact(lambda x: T.norm_key(x, kind), lambda v: _ascii_key(v, kind))(c)


def aliases(c: Column) -> Column:
    return F.filter(F.transform(F.split(norm_text(c), ALIAS_SEPARATORS), lambda x: F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")


def number_text(c: Column) -> Column:
    t = norm_text(c)
    exponent = t.rlike(r"^-?\d+(?:\.\d+)?[eE][+-]?\d+$")
    as_number = F.when(exponent, t).try_cast("double")
    return F.when(t.rlike(r"^-?\d+\.0+$"), F.substring_index(t, ".", 1)).when(exponent & (as_number == F.floor(as_number)), F.format_string("%.0f", as_number)).otherwise(t)


def clean_xml(c: Column) -> Column:
    return F.regexp_replace(c, ILLEGAL_XML, "")


def header_kind(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    low = F.lower(norm_text(c))

    def has(hints: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for h in hints:
            out = out | F.contains(low, F.lit(h.lower()))
        return out

    return F.when(has(lexicon.id_hints), "id").when(has(lexicon.name_hints), "name").when(has(lexicon.contact_hints), "contact").otherwise("other")


def logical_field(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    bare = F.lower(squeeze(F.regexp_replace(F.regexp_replace(c, "[（(].*[）)]", ""), "^(员工|人员)", "")))
    out = bare
    for field, words in reversed(lexicon.synonyms):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(c, F.lit(w)) | F.contains(bare, F.lit(w.lower()))
        out = F.when(found, field).otherwise(out)
    return out
