"""Most similar keys without comparing all pairs.

A ratio of matching blocks reaches the cutoff only if the keys share enough characters:
2 * |common characters| >= cutoff * (both lengths). Keys become sets of (character,
occurrence) items in one global order, rarest first; two keys that share enough items
share one of the first few of each (prefix filter), near enough to the front that enough
are left behind it (positional filter), and don't differ too much in length. Such pairs
are counted exactly in generated code, and only those that pass are compared in Python.

Where only the best few are asked for, the nearest come first. Matching blocks are a
common subsequence, so a pair whose ratio is high becomes equal when few characters are
deleted. Pairs that need one deletion in all are found by an equi-join of what deletions
leave, then, for keys that aren't settled, those that need two. A pair that needs more than
d deletions has a ratio of at most 2n / (2n + d + 1), n being the key's length; a key whose
last wanted candidate is better than that is settled. The other keys meet all candidates
that can reach their last wanted one by the filters above. Nothing is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_of(candidate: pa.Array, key: pa.Array) -> pa.Array:
    """The candidate is the first sequence; the measure isn't symmetric."""
    matcher, last, out = SequenceMatcher(), None, []
    for x, k in zip(candidate.to_pylist(), key.to_pylist()):
        if k != last:
            matcher.set_seq2(k)
            last = k
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def ratio(candidate: str, key: str) -> Column:
    return F.arrow_udf(ratio_of, "double")(candidate, key)


#: Deletions that are looked at, in this order, and the longest keys for which they are.
DELETIONS = ((1, 64), (2, 24))


def item_lists(df: DataFrame, key: str) -> DataFrame:
    """(key, n, items): each distinct key with its character occurrences, ``a:1``, ``a:2`` and so on; an empty key has none."""
    chars = F.filter(F.split("key", ""), lambda c: c != "")
    nth = F.transform(chars, lambda c, i: F.concat_ws(":", c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))))
    return df.select(F.col(key).alias("key")).distinct().select("key", F.char_length("key").alias("n"), nth.alias("items"))


def ordered(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """Items of each key, rarest first. ``counts`` (item_, times) has a row for each character occurrence there is, not for each key."""
    met = lists.select("key", "n", F.explode("items").alias("item")).join(counts, F.col("item") == F.col("item_"))
    return met.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("l")).select("key", "n", F.transform("l", lambda x: x["item"]).alias("items"))


def shared_characters(keys: DataFrame, pool: DataFrame, key: str = "key", cutoff: float = 0.5, floor: str | None = None) -> DataFrame:
    """(key, candidate, common): pairs whose characters allow the cutoff; a key isn't its own candidate.

    ``floor``: a column of ``keys`` with each key's own cutoff, which is at least the common one.
    """
    left, right = item_lists(keys, key), item_lists(pool, key)
    both = left.unionByName(right).select(F.explode("items").alias("item_"))
    counts = both.groupBy("item_").agg(F.count("*").alias("times"))

    def longest(share: Column) -> Column:
        return 1 / share - 1  # beyond this ratio of lengths the bound can't be met

    def need(share: Column, n: Column, m: Column) -> Column:
        return F.ceil(share * (n + m) - 1e-9)

    def firsts(lists: DataFrame, own: DataFrame | None = None) -> DataFrame:
        lists = ordered(lists, counts).withColumn("share", F.lit(cutoff / 2))
        if own is not None:
            lists = lists.drop("share").join(own, F.col("key") == F.col("own_key")).drop("own_key")
        # the shortest partner asks for the fewest common items
        least = need(F.col("share"), F.col("n"), F.ceil(F.col("n") / longest(F.col("share")) - 1e-9))
        prefix = F.slice("items", F.lit(1), F.greatest(F.lit(1), F.col("n") - least + 1).cast("int"))
        return lists.select("key", "n", "items", "share", F.posexplode(prefix).alias("p", "item"))

    own = None
    if floor:
        own = keys.groupBy(F.col(key).alias("own_key")).agg((F.greatest(F.lit(cutoff), F.max(floor)) / 2).alias("share"))
    a, b = firsts(left, own), firsts(right).select(F.col("key").alias("candidate"), F.col("n").alias("m"), F.col("items").alias("others"), F.col("p").alias("q"), "item")
    pairs = a.join(b, "item").where((F.col("key") != F.col("candidate")) & (F.greatest("n", "m") <= longest(F.col("share")) * F.least("n", "m") + 1e-9))
    least = need(F.col("share"), F.col("n"), F.col("m"))
    pairs = pairs.where(F.least("p", "q") + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= least)
    # only the pair's first shared item gives a row, so there is no need to make pairs distinct
    shared = F.array_intersect("items", "others")
    pairs = pairs.where(F.get(shared, F.lit(0)) == F.col("item")).withColumn("common", F.size(shared).cast("long"))
    return pairs.where(F.col("common") >= least).select("key", "candidate", "common")


def without(text: Column, times: int) -> Column:
    """The texts that are left when so many characters are deleted."""
    out = F.array(text)
    for _ in range(times):
        each = F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.char_length(t)))))
        out = F.array_distinct(F.flatten(each))
    return out


def by_deletions(keys: DataFrame, pool: DataFrame, most: int, cutoff: float) -> DataFrame:
    """(key, candidate): pairs that are equal after ``most`` deletions at most, of both together, if so many allow the cutoff."""

    def left(gone: int, there: int) -> DataFrame:
        rest = F.col("n") - gone
        part = keys.where((rest > 0) & (2 * rest >= cutoff * (2 * rest + gone + there) - 1e-9))
        return part.select("key", F.explode(without(F.col("key"), gone)).alias("text"), F.lit(there).alias("there"))

    def right(there: int) -> DataFrame:
        part = pool.where(F.col("m") > there)
        return part.select("candidate", F.explode(without(F.col("candidate"), there)).alias("text_"), F.lit(there).alias("there_"))

    a = b = None
    for there in range(most + 1):
        b = right(there) if b is None else b.unionByName(right(there))
        for gone in range(most + 1 - there):
            if gone + there:
                a = left(gone, there) if a is None else a.unionByName(left(gone, there))
    met = a.join(b, (F.col("text") == F.col("text_")) & (F.col("there") == F.col("there_")))
    return met.where("key <> candidate").select("key", "candidate").distinct()


def best_of(pairs: DataFrame, n: int, cutoff: float) -> DataFrame:
    """(near, best): each key's ``n`` best candidates as (rank, ratio, candidate), ties by the greater text."""
    scored = pairs.withColumn("ratio", ratio("candidate", "key")).where(F.col("ratio") >= cutoff)
    best = Window.partitionBy("key").orderBy(F.desc("ratio"), F.desc("candidate"))
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return top.groupBy(F.col("key").alias("near")).agg(F.sort_array(F.collect_list(F.struct("rank", "ratio", "candidate"))).alias("best"))


def kept(df: DataFrame) -> DataFrame:
    """A table that later steps read more than once, without its lineage; in the shared folder if there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def closest(keys: DataFrame, pool: DataFrame, key: str = "key", n: int = 3, cutoff: float = 0.5) -> DataFrame:
    """(key, closest): each key's ``n`` best candidates by ratio, ties by the greater text, joined by 、."""
    every = kept(pool.select(F.col(key).alias("candidate")).distinct().withColumn("m", F.char_length("candidate")))
    left = kept(keys.select(F.col(key).alias("key")).distinct().withColumn("n", F.char_length("key")).withColumn("floor", F.lit(cutoff)))
    found = None
    for most, longest in DELETIONS:
        near = best_of(by_deletions(left.where(F.col("n") <= longest), every.where(F.col("m") <= longest + most), most, cutoff), n, cutoff)
        met = left.join(near, F.col("key") == F.col("near"), "left")
        last = F.when(F.size("best") == n, F.element_at("best", -1)["ratio"])
        # the best of the pairs that weren't looked at
        others = F.when(F.col("n") <= longest, 2 * F.col("n") / (2 * F.col("n") + most + 1)).otherwise(1.0)
        met = kept(met.select("key", "n", F.greatest("floor", last).alias("floor"), "best", F.coalesce((others < cutoff) | (last > others), F.lit(False)).alias("settled")))
        done = met.where("settled AND best IS NOT NULL").select("key", "best")
        found = done if found is None else found.unionByName(done)
        left = met.where("NOT settled").select("key", "n", "floor")
        if left.isEmpty():
            break
    else:
        rest = best_of(shared_characters(left, every.select(F.col("candidate").alias("key")), "key", cutoff, "floor"), n, cutoff)
        found = found.unionByName(rest.select(F.col("near").alias("key"), "best"))
    return found.select("key", F.array_join(F.transform("best", lambda x: x["candidate"]), "、").alias("closest"))
