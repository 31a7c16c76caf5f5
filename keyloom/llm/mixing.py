"""Mixing sources to target weights by capped water-filling.

``water_levels`` clamps each source at ``max_epochs`` times its size and shares what
is left among the others in proportion to their weights, round by round, until no
source is above its cap. ``mix`` then samples seeded whole and fractional repetitions.

Defined results: a null or empty text has size 0, and 0 words of it are taken; a null
source is a source of its own (ranked last); tied ids fall in one order by their text's
digest; repeated rows are planned row by row, each with copies of its own, and rows that
differ only in columns that aren't read are told apart by these, so ``mix`` gives just as
many rows as the plan says; an empty table gives an empty result; other columns of the
input are not read by ``plan_mix`` and are carried unchanged by ``mix``, whatever their
names. Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged

#: The cut of a source is looked for in this many steps, each by so many hexadecimal digits of the order's hash.
STEPS, DIGITS = 2, 2
#: Up to so many sources are levelled on the driver (two numbers each), more of them in tables.
DRIVER_SOURCES = 100_000


def size_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh 1..cycle, repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", ((rank - 1) % cycle + 1).cast("long"))


def water_levels(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of (source, source_size, weight) rows, as a ``target`` column.

    Round by round: share the free amount by weight, clamp every source whose share is
    over its cap, and give the excess back to the rest. A round clamps at least one
    source. Few sources are levelled on the driver; of more, it sees two totals a round.
    """
    cap = max_epochs * F.col("source_size")
    held = sources.select("source_size", "weight").limit(DRIVER_SOURCES + 1).collect()
    if len(held) <= DRIVER_SOURCES:
        level = final_level([(r.source_size, r.weight) for r in held], max_epochs)
    else:
        total, level = sources.agg(F.sum("source_size")).first()[0], None
        while True:
            clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
            used, weight = sources.agg(F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("weight")))).first()
            new = float(total - used) / float(weight) if weight else None
            if new is None or level is not None and new <= level:
                level = level if weight else None
                break
            level = new
    if level is None:  # every source is at its cap
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) >= cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def final_level(sources: list[tuple[int, int]], max_epochs: int) -> float | None:
    """The share of one unit of weight once no source is above its cap; None if all are at it."""
    total, level = sum(n for n, _ in sources), None
    while True:
        free = [(n, w) for n, w in sources if level is None or w * level < max_epochs * n]
        weight = sum(w for _, w in free)
        if not weight:
            return None
        new = float(total - max_epochs * (sum(n for n, _ in sources) - sum(n for n, _ in free))) / float(weight)
        if level is not None and new <= level:
            return level
        level = new


def planned(rows: DataFrame, max_epochs: int, cycle: int) -> DataFrame:
    """``rows`` (source, size, order_key, tie, ...) with source_size, target and copies.

    A source gets floor(target / source_size) copies of every row, and one more of the
    rows that come first in the seeded hash order until the rest of the target is met;
    the last of them is taken if that comes nearer. No sum runs over a whole source: the
    sums of 256 hash ranges tell in which range the cut is, the sums of that one's 256
    parts tell in which part, and only that part is looked at row by row.
    """
    sums = staged(rows.groupBy("source", F.substring("order_key", 1, DIGITS).alias("part")).agg(F.sum("size").alias("part_size")), "mix-sums")
    levels = water_levels(staged(ranked_sources(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), cycle), "mix-sources"), max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cuts = levels.withColumn("whole", F.floor(share).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = cuts.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("base"))
    same = F.col("source").eqNullSafe(F.col("s"))
    for step in range(1, STEPS + 1):
        if step > 1:
            within = rows.join(cuts.select("s", "cut"), same).where(F.substring("order_key", 1, DIGITS * (step - 1)) == F.col("cut"))
            sums = within.groupBy("source", F.substring("order_key", 1, DIGITS * step).alias("part")).agg(F.sum("size").alias("part_size"))
        upto = Window.partitionBy("source").orderBy("part")  # at most 16 ** DIGITS rows
        run = sums.withColumn("done", F.sum("part_size").over(upto)).join(cuts.select("s", "rest", "base"), same)
        over = run.where(F.col("base") + F.col("done") > F.col("rest"))
        first = over.groupBy(F.col("source").alias("s_")).agg(F.min(F.struct("part", (F.col("base") + F.col("done") - F.col("part_size")).alias("base"))).alias("c"))
        cuts = cuts.join(first, F.col("s").eqNullSafe(F.col("s_")), "left")
        cuts = staged(cuts.select("s", "source_size", "target", "whole", "rest", F.col("c.part").alias("cut"), F.coalesce("c.base", "base").alias("base")), "mix-cuts")
    dealt = rows.join(cuts, same)
    part = F.substring("order_key", 1, DIGITS * STEPS)
    # a source without a cut has no words
    sure = dealt.where(F.col("cut").isNull() | (part != F.col("cut"))).withColumn("extra", F.when(part < F.col("cut"), 1).otherwise(0))
    inside = Window.partitionBy("source").orderBy("order_key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.where(part == F.col("cut")).withColumn("done", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    met = met.withColumn("extra", F.when(F.col("done") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("done")
    return sure.unionByName(met).withColumn("copies", (F.col("whole") + F.col("extra")).cast("long")).drop("s", "whole", "rest", "cut", "base", "extra")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    text_key = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), text_key.alias("text_key"), *more)
    return rows.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "text_key")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, cycle: int = 3, seed: int = 7) -> DataFrame:
    """(id, text_key, source, size, source_size, target, copies, taken): how many whole repetitions each row gets."""
    rows = staged(keyed(docs, id_col, text_col, source_col, seed, F.lit(0).alias("tie")), "mix-rows")
    out = planned(rows, max_epochs, cycle)
    return out.select(F.col("id").alias(id_col), "text_key", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, cycle: int = 3, seed: int = 7) -> DataFrame:
    """The mixed rows themselves: each input row as often as its plan says, all columns kept.

    Rows carry their columns through the plan, so they aren't joined back by values, and
    only the rows around the cuts are shuffled.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tie = F.xxhash64(*(c for c, f in zip(columns, docs.schema) if "map<" not in f.dataType.simpleString()))
    rows = staged(keyed(docs, id_col, text_col, source_col, seed, tie.alias("tie"), F.struct(*columns).alias("row")), "mix-rows")
    out = planned(rows, max_epochs, cycle).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
