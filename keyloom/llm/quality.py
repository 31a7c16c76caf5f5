"""Quality rules: repetition inside a document, and lines that many documents of a host share.

Lines are normalised (lower case, digits to 0, runs of white space to one space) and
hashed. For each host and line the distinct documents are counted; a line in more than
``max_docs`` of them is removed from all but the text with the smallest id that has it. A
document left with fewer than ``min_words`` words or less than ``min_share`` of its words
is rejected as depleted. ``strip_lines`` gives the texts that are left.

Documents are distinct by their texts: exact copies count as one, as the copies of a
clean document would otherwise make each of its lines frequent and reject it everywhere.
``distinct="ids"`` counts them by their ids.

A line that a third of a host's documents share is counted before it is shuffled, and
where the frequent lines meet the texts again, the side that repeats is the one that the
adaptive skew join splits: the other has one row for each line.

Defined results: a null or empty text has no words and fails the base rule; a null host
is a host of its own; a null id counts by its text; repeated rows give repeated results;
tied ids are told apart by their texts; an empty table gives an empty one; other columns
are not read by ``quality`` and are kept by ``strip_lines``, whatever their names. Any
length of text is read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, staged

SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
ROWS = f"id long, host string, text_key long, {BASE}, line_keys array<long>, line_words array<int>"


def key_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def line_key(parts: list[bytes]) -> int:
    """The key of a line's normal form, from its words."""
    return key_of(DIGIT.sub(b"0", b" ".join(parts).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")))


def key_column(text: Column) -> Column:
    """The ``text_key`` of ``measured``."""

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array([key_of((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.int64())

    return key(text)


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Word places that lie in an n-word window found at least twice."""
    if len(words) <= n:
        return 0
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    twice = np.array([i for i, w in enumerate(windows) if count[w] > 1])
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + n, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """Base counts, and a key and word count for each line with a word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blank = sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS)) if has_symbol(text) else 0
    seen: set[bytes] = set()
    dup, keys, sizes = 0, [], []
    for line in data.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        keys.append(line_key(parts))
        sizes.append(len(parts))
    return key_of(data), len(words), len(text) - blank, symbols, dup, repeat_words(words), keys, sizes


has_symbol = re.compile("[" + re.escape(SYMBOLS) + "]").search
DIGIT = re.compile(rb"[0-9]")


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*map(measure, batch.column(2).to_pylist()))) or [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_keys", "line_words"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(x), k) for x, k in zip(got, kinds))], ["id", "host", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ROWS)


def removed_lines(rows: DataFrame, max_docs: int, distinct: str) -> DataFrame:
    """(host, text_key, line, words, lines) of the lines that go from a text, for ``measured`` rows."""
    unit = F.col("text_key") if distinct == "texts" else F.coalesce("id", "text_key")
    lines = rows.select("host", "text_key", "id", unit.alias("unit"), F.explode(F.array_distinct("line_keys")).alias("line"))
    # (host, line, document) without copies, then documents for each (host, line): both sum up before they shuffle
    least = F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "text_key")).alias("least")
    counts = lines.groupBy("host", "line", "unit").agg(least).groupBy("host", "line").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    frequent = counts.where(F.col("n") > max_docs).select(F.col("host").alias("h"), F.col("line").alias("often"), F.col("least.text_key").alias("first"))
    placed = rows.select("id", "host", "text_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("id", "host", "text_key", F.col("l.line_keys").alias("line"), F.col("l.line_words").alias("words"))
    per_text = placed.groupBy("host", "text_key", "line").agg(F.sum("words").alias("words"), F.count("*").alias("lines"))
    # a text's copies all say the same; per copy is what counts
    copies = rows.groupBy(F.col("host").alias("h2"), F.col("text_key").alias("k2")).agg(F.count("*").alias("copies"))
    gone = per_text.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("often")) & (F.col("text_key") != F.col("first")))
    gone = gone.join(copies, F.col("host").eqNullSafe(F.col("h2")) & (F.col("text_key") == F.col("k2")))
    each = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    return gone.select(F.col("host").alias("h"), F.col("text_key").alias("k"), "line", each("words"), each("lines"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, min_words: int = 10, min_share: float = 0.3, distinct: str = "texts") -> DataFrame:
    """Base counts, ``base_failed``, ``n_removed_lines``, ``n_left_words`` and ``kept``, a row for each input row."""
    rows = staged(measured(docs, id_col, text_col, host_col), "quality")
    removed = removed_lines(rows, max_docs, distinct).groupBy("h", "k").agg(F.sum("words").alias("lost_words"), F.sum("lines").alias("lost_lines"))
    all_rows = rows.drop("line_keys", "line_words").join(removed, F.col("host").eqNullSafe(F.col("h")) & (F.col("text_key") == F.col("k")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    lost = F.coalesce("lost_lines", F.lit(0))
    depleted = (lost > 0) & ((left < min_words) | (left < min_share * F.col("n_words")))
    return all_rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), lost.alias("n_removed_lines"), left.alias("n_left_words"))


def strip_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, distinct: str = "texts") -> DataFrame:
    """``docs`` without the lines that are frequent in their host; other lines stay as they are."""
    rows = staged(measured(docs, id_col, text_col, host_col), "quality")
    gone = removed_lines(rows, max_docs, distinct).groupBy("h", "k").agg(F.collect_list("line").alias("lines"))
    host, key, lines = free_names(docs, "host", "key", "lines")
    gone = gone.select(F.col("h").alias(host), F.col("k").alias(key), F.col("lines").alias(lines))
    own = free_names(docs, "own")[0]
    keyed = docs.withColumn(own, key_column(F.col(text_col)))
    met = keyed.join(gone, F.col(host_col).cast("string").eqNullSafe(F.col(host)) & (F.col(own) == F.col(key)), "left")

    @F.arrow_udf("string")
    def left(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([t if not x else "\n".join(without(t, set(x))) for t, x in zip(texts.to_pylist(), lists.to_pylist())], pa.string())

    return met.withColumn(text_col, left(F.col(text_col), F.col(lines))).select(*[F.col(f"`{c}`") for c in docs.columns])


def without(text: str, gone: set[int]) -> Iterator[str]:
    for line in text.split("\n"):
        parts = line.encode("utf-8", "surrogatepass").split()
        if not parts or line_key(parts) not in gone:
            yield line
