"""N-way outer merge on normalised keys, in one shuffle.

All sources are tagged and unioned; one aggregation by key takes each source's first row
(smallest row index), so there is one exchange whatever the number of sources, and a hot
key is combined before it. Everything else (status, conflicts, unmatched records,
coverage) is derived from that merged table row by row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MergeInputError
from ..functions import columns as C
from ..functions.text import header_kind, logical_field
from ..lexicon import COMPLETE, KEY, POLICIES, STATUS, UNMATCHED_HEADERS
from ..sources.reader import ROW, Table
from .similar import closest


@dataclass
class Source:
    table: Table
    key_col: str
    fields: list[str] | None = None
    kind: str | None = None

    def __post_init__(self) -> None:
        headers = self.table.info.headers
        if self.key_col not in headers:
            raise MergeInputError(f"表 {self.file} 不存在键列“{self.key_col}”（表头为：{'、'.join(headers)}）")
        self.kind = self.kind or ("id" if header_kind(self.key_col) == "id" else "name")
        wanted = self.fields or headers
        self.columns = [c for c in wanted if c != self.key_col and c in headers]

    @property
    def file(self) -> str:
        return self.table.info.file


class Merge:
    """A planned merge; every property is a lazy DataFrame.

    ``exact``: keys by the exact rules (Arrow UDFs) or by the native ones, which stay in
    generated code and agree on all but rare compatibility characters.
    """

    def __init__(self, sources: list[Source], primary: str | None = None, policy: str = "separate_sheet", exact: bool = True) -> None:
        files = [s.file for s in sources]
        if len(sources) < 2:
            raise MergeInputError("至少需要 2 个表格文件。")
        if len(set(files)) < len(files):
            raise MergeInputError(f"输入文件重复：{next(f for f in files if files.count(f) > 1)}")
        if policy not in POLICIES:
            raise MergeInputError(f"unmatched_policy 非法：{policy}")
        self.sources, self.primary, self.policy, self.exact = sources, primary, policy, exact
        self.files = files

    @cached_property
    def outputs(self) -> list[tuple[int, int, str]]:
        """(source, column, output name) in plan order."""
        return [(i, j, f"{c}（来源：{s.file}）") for i, s in enumerate(self.sources) for j, c in enumerate(s.columns)]

    @cached_property
    def groups(self) -> list[tuple[str, list[tuple[int, int, str]]]]:
        """Logical fields that columns of two or more sources stand for, by first appearance."""
        found: dict[str, list[tuple[int, int, str]]] = {}
        for x in self.outputs:
            found.setdefault(logical_field(self.sources[x[0]].columns[x[1]]), []).append(x)
        return [(name, cols) for name, cols in found.items() if len({i for i, _, _ in cols}) > 1]

    def keyed(self, i: int) -> DataFrame:
        """(raw, key, row, values) of a source's rows; raw is the normalised cell, blank where there is no key."""
        s = self.sources[i]
        cell = F.col(f"`{s.key_col}`")
        values = F.struct(cell.alias("k"), *[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(s.columns)])
        text = C.norm_text_exact if self.exact else C.norm_text
        key = (lambda c: C.norm_key_exact(c, s.kind)) if self.exact else (lambda c: C.norm_key(c, s.kind))
        rows = s.table.df.select(text(cell).alias("raw"), F.col(ROW).alias("row"), values.alias("v"))
        return rows.withColumn("key", key(F.col("raw")))

    def rank(self, i: int) -> int:
        return 0 if self.files[i] == self.primary else i + 1

    @cached_property
    def merged(self) -> DataFrame:
        """(key, ord, v0, v1, ..., f<i>_<j>): each source's first row of the key, or null, and the normalised cells of logical fields."""
        union = None
        for i in range(len(self.sources)):
            part = self.keyed(i).where("raw <> ''").select("key", F.struct(F.lit(self.rank(i)).alias("rank"), F.col("row")).alias("ord"), F.col("row").alias(f"r{i}"), F.col("v").alias(f"v{i}"))
            union = part if union is None else union.unionByName(part, allowMissingColumns=True)
        firsts = [F.min_by(F.col(f"v{i}"), F.col(f"r{i}")).alias(f"v{i}") for i in range(len(self.sources))]
        rows = union.groupBy("key").agg(F.min("ord").alias("ord"), *firsts)
        # cells that are compared are normalised once, of first rows only
        return rows.withColumns({f"f{i}_{j}": self.normal(F.col(f"v{i}.c{j}")) for _, cols in self.groups for i, j, _ in cols})

    def persist(self) -> Merge:
        self.merged.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.merged.unpersist()

    def present(self, i: int) -> Column:
        return F.col(f"v{i}").isNotNull()

    @property
    def everywhere(self) -> Column:
        out = F.lit(True)
        for i in range(len(self.sources)):
            out = out & self.present(i)
        return out

    @property
    def missing(self) -> Column:
        names = [F.when(~self.present(i), F.lit(f)) for i, f in enumerate(self.files)]
        return F.array_join(F.array_compact(F.array(*names)), "、")

    def normal(self, cell: Column) -> Column:
        return F.nullif((C.norm_text_exact if self.exact else C.norm_text)(cell), F.lit(""))

    def cell(self, i: int, j: int) -> Column:
        return F.col(f"v{i}.c{j}")

    def filled(self, i: int, j: int) -> Column:
        """The normalised cell of a first row; null where it is blank or absent."""
        return F.col(f"f{i}_{j}")

    def conflict(self, cols: list[tuple[int, int, str]]) -> Column:
        return F.size(F.array_distinct(F.array_compact(F.array(*[self.filled(i, j) for i, j, _ in cols])))) > 1

    @property
    def status(self) -> Column:
        flags = [F.when(~self.everywhere, F.concat(F.lit("部分缺失（缺："), self.missing, F.lit("）")))]
        flags += [F.when(self.conflict(cols), F.lit(f"冲突：{name}")) for name, cols in self.groups]
        text = F.array_join(F.array_compact(F.array(*flags)), "；")
        return F.when(text == "", COMPLETE).otherwise(text)

    def result(self, ordered: bool = True) -> DataFrame:
        """The wide table; under ``drop`` only keys that every source has."""
        rows = self.merged.where(self.everywhere) if self.policy == "drop" else self.merged
        rows = rows.orderBy("ord") if ordered else rows
        return rows.select(F.col("key").alias(KEY), *[F.coalesce(self.cell(i, j), F.lit("")).alias(name) for i, j, name in self.outputs], self.status.alias(STATUS))

    def unmatched(self, similar: bool = True, ordered: bool = True) -> DataFrame:
        """A row for each key and source that has it, where another source lacks it."""
        records = [F.when(self.present(i), F.struct(F.lit(i).alias("i"), F.lit(f).alias("file"), F.coalesce(F.col(f"v{i}.k"), F.lit("")).alias("raw"))) for i, f in enumerate(self.files)]
        part = self.merged.where(~self.everywhere)
        rows = part.select("key", "ord", self.missing.alias("missing"), F.explode(F.array_compact(F.array(*records))).alias("x"))
        if similar:
            near = closest(part.select("key"), self.merged.select("key")).withColumnRenamed("key", "near")
            rows = rows.join(near, F.col("key") == F.col("near"), "left")
        else:
            rows = rows.withColumn("closest", F.lit(""))
        rows = rows.orderBy("ord", "x.i") if ordered else rows
        cols = ("x.file", "x.raw", "key", "missing")
        return rows.select(*[F.col(c).alias(h) for c, h in zip(cols, UNMATCHED_HEADERS)], F.coalesce("closest", F.lit("")).alias(UNMATCHED_HEADERS[4]))

    def conflicts(self, ordered: bool = True) -> DataFrame:
        """(关联键, 逻辑字段, 取值) of every disagreement, whatever the policy."""
        found = []
        for g, (name, cols) in enumerate(self.groups):
            values = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{out}="), self.filled(i, j)) for i, j, out in cols])), "；")
            found.append(F.when(self.conflict(cols), F.struct(F.lit(g).alias("g"), F.lit(name).alias("f"), values.alias("v"))))
        if not found:
            return self.merged.where("false").select(F.col("key").alias(KEY), F.lit("").alias("逻辑字段"), F.lit("").alias("取值"))
        rows = self.merged.select("key", "ord", F.explode(F.array_compact(F.array(*found))).alias("x"))
        rows = rows.orderBy("ord", "x.g") if ordered else rows
        return rows.select(F.col("key").alias(KEY), F.col("x.f").alias("逻辑字段"), F.col("x.v").alias("取值"))

    def counts(self) -> DataFrame:
        """One row: n_keys, n_result_rows, n_unmatched, n_conflicts, and matched_<i> of each source."""
        here = [self.present(i).cast("long") for i in range(len(self.sources))]
        n_present = sum(here[1:], here[0])
        clashes = sum((self.conflict(cols).cast("long") for _, cols in self.groups), F.lit(0).cast("long"))
        whole = self.everywhere
        kept = whole.cast("long") if self.policy == "drop" else F.lit(1).cast("long")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return self.merged.agg(
            F.count("*").alias("n_keys"),
            total(kept).alias("n_result_rows"),
            total(F.when(whole, 0).otherwise(n_present)).alias("n_unmatched"),
            total(clashes).alias("n_conflicts"),
            *[total(h).alias(f"matched_{i}") for i, h in enumerate(here)],
        )

    def key_groups(self, i: int) -> DataFrame:
        """(key, n, first) of a source's keys, with the first row that has each."""
        return self.keyed(i).where("raw <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first"))

    def duplicate_keys(self, i: int) -> DataFrame:
        return self.key_groups(i).where("n > 1")

    def blank_keys(self, i: int) -> DataFrame:
        """The source's rows without a key, which take no part in the merge."""
        s = self.sources[i]
        text = C.norm_text_exact(F.col(f"`{s.key_col}`")) if self.exact else C.norm_text(F.col(f"`{s.key_col}`"))
        return s.table.df.where(text == "")
