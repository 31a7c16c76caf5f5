"""Exported files as string tables with a materialised row order.

``read_table`` parses on an executor (any store Spark can read) into (row, cells) rows,
finds the header among the first ten, drops columns that are empty everywhere, and
selects the rest by place. ``from_table`` lifts a typed DataFrame into the same model.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MergeInputError
from ..functions.text import header_kind, name_headers
from .grids import read_grid

ROW = "__row_idx"
HEADER_ROWS = 10


@dataclass
class TableInfo:
    file: str
    path: str = ""
    headers: list[str] = field(default_factory=list)
    n_rows: int = 0
    n_cols: int = 0
    header_row: int = 1
    format: str | None = None
    encoding: str | None = None
    delimiter: str | None = None
    sheet: str | None = None
    note: str | None = None

    def profile(self) -> dict:
        return asdict(self) | {"col_kinds": {h: header_kind(h) for h in self.headers}}


@dataclass
class Table:
    """A DataFrame of text columns named by ``info.headers`` plus ROW."""

    df: DataFrame
    info: TableInfo


def grid_of(spark: SparkSession, path: str) -> DataFrame:
    """(row, cells) of one file; row -1 carries what was found, or why it can't be read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows, info = read_grid(os.path.basename(name), raw)
                except MergeInputError as e:
                    rows, info = [], {"error": str(e)}
                rows = [[json.dumps(info)], *rows]
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo - 1, lo - 1 + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], ["row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "row long, cells array<string>")


def shaped(grid: DataFrame) -> tuple[list[int], list[str], int]:
    """Places of the columns that hold anything, their headers, and the header's row."""
    used = sorted(r[0] for r in grid.select(F.posexplode("cells").alias("place", "cell")).where("cell <> ''").select("place").distinct().collect())
    first = grid.orderBy("row").limit(HEADER_ROWS).collect()
    if not first or not used:
        return [], [], 0
    at = next((r for r in first if sum(bool(c) for c in r.cells) >= 2), first[0])
    cells = [at.cells[p] if p < len(at.cells) else "" for p in used]
    return used, name_headers(cells), at.row


def read_table(spark: SparkSession, path: str) -> Table:
    try:
        grid = grid_of(spark, path).persist(StorageLevel.MEMORY_AND_DISK)
        found = grid.where("row = -1").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise MergeInputError(f"文件不存在：{path}") from None
        raise
    if len(found) != 1:
        raise MergeInputError(f"文件不存在：{path}" if not found else f"不是单个文件：{path}")
    info = json.loads(found[0].cells[0])
    if "error" in info:
        raise MergeInputError(info["error"])
    grid = grid.where("row >= 0")
    used, headers, at = shaped(grid)
    if not headers:
        raise MergeInputError(f"文件中没有可读取的数据行：{path}")
    data = grid.where(F.col("row") > at)
    cells = [F.coalesce(F.get("cells", F.lit(p)), F.lit("")).alias(h) for p, h in zip(used, headers)]
    df = data.select(*cells, (F.col("row") - at - 1).alias(ROW))
    known = {k: info.get(k) for k in ("format", "encoding", "delimiter", "sheet", "note")}
    return Table(df, TableInfo(os.path.basename(path), path, headers, df.count(), len(headers), at + 1, **known))


def to_text(df: DataFrame, name: str) -> Column:
    """Typed values as text: plain integers, two decimals for fractions, ISO-like times."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("decimal(38,2)")
    elif isinstance(kind, T.TimestampType):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(c.cast("string"), F.lit(""))


def from_table(df: DataFrame, file: str, order: str | Column, columns: list[str] | None = None, count: bool = False) -> Table:
    """A typed DataFrame in the text model. ``order``: a unique column that gives the row order."""
    names = columns or df.columns
    order = F.col(order) if isinstance(order, str) else order
    texts = df.select(*[to_text(df, n).alias(n) for n in names], order.cast("long").alias(ROW))
    return Table(texts, TableInfo(file, headers=names, n_cols=len(names), n_rows=texts.count() if count else 0, format="table"))


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> Table:
    """A large delimited text of known form, read by Spark's own splittable reader."""
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, quote='"', escape='"')
    df = df.withColumn(ROW, F.monotonically_increasing_id())
    names = [c for c in df.columns if c != ROW]
    return Table(df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], ROW), TableInfo(os.path.basename(path), path, names, 0, len(names), format="delimited", encoding=encoding, delimiter=sep))
