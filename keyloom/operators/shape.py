"""Shape rules on tables whose rows are arrays of cells (row, cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def used_places(grid: DataFrame) -> DataFrame:
    """(place) of columns with any non-empty cell."""
    return grid.select(F.posexplode("cells").alias("place", "cell")).where("cell <> ''").select("place").distinct()


def drop_empty_columns(grid: DataFrame) -> DataFrame:
    places = grid.select(F.posexplode("cells").alias("place", "cell")).where("cell <> ''").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return grid.crossJoin(F.broadcast(places)).select("row", F.transform("places", lambda p: F.coalesce(F.get("cells", p), F.lit(""))).alias("cells"))


def blank_rows_out(grid: DataFrame) -> DataFrame:
    return grid.where(F.exists("cells", lambda c: c != ""))


def header_row(grid: DataFrame, within: int = 10) -> DataFrame:
    """(row) of the first of the first ``within`` rows with two filled cells, else of the first row."""
    first = grid.orderBy("row").limit(within)
    good = F.size(F.filter("cells", lambda c: c != "")) >= 2
    return first.agg(F.coalesce(F.min(F.when(good, F.col("row"))), F.min("row")).alias("row"))


def sample(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(max(0, n))
