"""``spark.read.format("officetable").load(path)``: the parsed grid of one file as a Python data source."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import name_headers
from .grids import read_grid
from .reader import ROW


def table_rows(path: str) -> tuple[list[str], list[list[str]]]:
    with open(path, "rb") as f:
        rows, _ = read_grid(os.path.basename(path), f.read())
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    used = [p for p in range(width) if any(r[p] for r in rows)]
    at = next((i for i, r in enumerate(rows[:10]) if sum(map(bool, r)) >= 2), 0)
    return name_headers([rows[at][p] for p in used]) if rows else [], [[r[p] for p in used] for r in rows[at + 1 :]]


class OfficeTable(DataSource):
    """Local or mounted files; ``read_table`` reads any store."""

    @classmethod
    def name(cls) -> str:
        return "officetable"

    def schema(self) -> str:
        headers, _ = table_rows(self.options["path"])
        return ", ".join([*(f"`{h.replace('`', '``')}` string" for h in headers), f"{ROW} long"])

    def reader(self, schema) -> DataSourceReader:
        return OfficeReader(self.options["path"])


class OfficeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        for i, row in enumerate(table_rows(self.path)[1]):
            yield (*row, i)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeTable)
