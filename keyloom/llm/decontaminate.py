"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask selects some of the word positions of a window and ignores the others, so a hit
survives substituted words at ignored places. Seeds of the benchmark are joined with
seeds of all windows of the training texts; each hit fixes an alignment, along which the
item's words are compared with the text's (substitutions cost a word each). A text holds
an item if at least ``threshold`` of the item's words agree along one alignment.

No alignment at the threshold is missed. ``survives`` counts, for each length of an
item, how many words must be lost until a mask has no whole window left; items that may
lose fewer are found by the mask. Any other item (a short one, or one under a low
threshold) that may lose m words is cut into m + 1 parts, and each part's first words
(RUN at most) are a seed: one part at least is whole in every text that holds the item.
Run lengths that no item needs cost nothing.

Seeds (a hash and two numbers each) and items are broadcast only up to ``max_broadcast``
seeds, whose number also bounds the words of all items; beyond that they meet by
shuffles that carry no texts. Items of more than PIECE words are compared with whole
texts, joined by id, so that they don't widen every piece.

Defined results: null and empty texts and items hold nothing; items and texts of any
length are matched (items under five words, at 0.8, only as a whole); repeated items
(same id and text) count once, tied item ids are reported once, with the best agreement;
repeated rows give one result for each id and text; empty tables give an empty one;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, staged
from .words import spaced, word_array

#: Seeds of spaced words. The weight is the most that 20 % of substitutions can't avoid in items of any length.
MASKS = ("11011",)
#: Longest run of words that is a seed of its own.
RUN = 4
MAX_BROADCAST = 500_000
#: Window starts of a piece of a text, and the most words on each side of them.
PIECE = 256
#: Up to this length ``survives`` looks at all patterns of lost words.
COUNTED = 96


def word_hashes(text: str) -> Column:
    return F.transform(word_array(spaced(text)), lambda w: F.xxhash64(w))


def fewest_losses(mask: str, longest: int = COUNTED) -> list[int]:
    """For each length, the fewest lost words that leave no whole window of ``mask``."""
    span, ones = len(mask), int(mask, 2)
    # lost words among the last span - 1, and the fewest lost so far
    least = {0: 0}
    out = []
    for n in range(longest + 1):
        out.append(min(least.values()) if n >= span else 0)
        step: dict[int, int] = {}
        for recent, lost in least.items():
            for bit in (0, 1):
                now = (recent << 1 | bit) & (1 << span) - 1
                if n + 1 >= span and not now & ones:
                    continue
                step[now] = min(step.get(now, longest), lost + bit)
        least = step
    return out


def survives(mask: str, n: int, lost: int) -> bool:
    """Whether ``lost`` words of ``n``, wherever they are, leave a whole window of the mask."""
    if n <= COUNTED:
        return n >= len(mask) and lost < fewest_losses(mask, n)[n]
    return n - len(mask) + 1 > mask.count("1") * lost


def seed(hashes: str, at: str, mask: str) -> Column:
    """The seed of the window that begins at word ``at``; null past the end."""
    picked = [F.expr(f"get({hashes}, {at} + {i})") for i, x in enumerate(mask) if x == "1"]
    return F.when(F.expr(f"{at} + {len(mask)} <= size({hashes})"), F.xxhash64(F.lit(mask), *picked))


def pieces(rows: DataFrame, margin: int, shortest: int) -> DataFrame:
    """Texts cut into pieces of PIECE window starts, each with ``margin`` words more on both sides.

    ``h`` becomes the piece, ``low`` the place of its first word in the text, ``first`` and
    ``last`` the piece's own window starts, counted from ``low``. No row that is repeated
    for each window holds a whole text.
    """
    rows = rows.where(F.size("h") >= shortest)
    rows = rows.select("*", F.explode(F.expr(f"sequence(0, (size(h) - {shortest}) div {PIECE})")).alias("c"))
    rows = rows.withColumn("low", F.expr(f"greatest(cast(c as int) * {PIECE} - {margin}, 0)"))
    rows = rows.withColumn("first", F.expr(f"cast(c as int) * {PIECE} - low"))
    rows = rows.withColumn("last", F.expr(f"least(first + {PIECE - 1}, size(h) - {shortest} - low)"))
    return rows.withColumn("h", F.expr(f"slice(h, low + 1, first + {PIECE} + {margin})")).drop("c")


def positions(rows: DataFrame, masks: list[str]) -> DataFrame:
    """A row for each seed of each window start from ``first`` to ``last``."""
    rows = rows.select("*", F.explode(F.expr("sequence(first, last)")).alias("at"))
    if len(masks) == 1:
        rows = rows.withColumn("seed", seed("h", "at", masks[0]))
    else:
        rows = rows.select("*", F.explode(F.array(*(seed("h", "at", m) for m in masks))).alias("seed"))
    return rows.where("seed IS NOT NULL")


def sown_seeds(items: DataFrame, sizes: list[int], threshold: float, masks: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(seed, no, item_at) of the benchmark, and the masks that the texts need."""
    lost = {n: n - math.ceil(threshold * n - 1e-9) for n in sizes}
    spaced_by = {m: [n for n in sizes if survives(m, n, lost[n])] for m in masks}
    taken: set[int] = set()
    used, parts_of = [], []
    for m in masks:
        lengths = [n for n in spaced_by[m] if n not in taken]
        taken |= set(lengths)
        if lengths:
            rows = items.where(F.size("h").isin(lengths)).withColumn("first", F.lit(0)).withColumn("last", F.size("h") - len(m))
            parts_of.append(positions(rows, [m]).select("seed", "no", F.col("at").alias("item_at")))
            used.append(m)
    runs: dict[int, list[int]] = {}
    for n in sizes:
        if n not in taken:
            runs.setdefault(min(RUN, max(1, n // (lost[n] + 1))), []).append(n)
    for r, lengths in sorted(runs.items()):
        m = "1" * r
        rows = items.where(F.size("h").isin(lengths)).withColumn("lost", F.size("h") - F.ceil(F.lit(threshold) * F.size("h") - 1e-9).cast("int"))
        rows = rows.withColumn("part", F.expr("greatest(size(h) div (lost + 1), 1)").cast("int"))
        rows = rows.select("h", "no", F.explode(F.expr("transform(sequence(0, lost), j -> j * part)")).alias("at"))
        parts_of.append(rows.select(seed("h", "at", m).alias("seed"), "no", F.col("at").alias("item_at")).where("seed IS NOT NULL"))
        used.append(m)
    out = parts_of[0]
    for x in parts_of[1:]:
        out = out.unionByName(x)
    return out, used


def agreed(hits: DataFrame, threshold: float) -> DataFrame:
    """(id, text_key, item, item_words, n_matched, start) of hits that hold the item: words of the item beside words of ``h`` from ``at`` on."""
    same = F.expr("size(filter(transform(item_h, (w, i) -> w = get(h, at + i)), x -> x))")
    found = hits.select("id", "text_key", "item", F.size("item_h").alias("item_words"), same.alias("n_matched"), (F.col("low") + F.col("at")).alias("start"))
    return found.where(F.col("n_matched") >= threshold * F.col("item_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, masks: tuple[str, ...] = MASKS, max_broadcast: int = MAX_BROADCAST, piece_words: int = PIECE) -> DataFrame:
    """(id, text_key, item, item_words, n_matched, start, overlap): each text and item that meet, at the best alignment."""
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(item_text_col).alias("h")).where(F.size("h") > 0).distinct()
    items = staged(items.withColumn("no", F.monotonically_increasing_id()), "items")
    total = items.agg(F.collect_set(F.size("h")).alias("sizes"), F.sum(F.size("h")).alias("words")).first()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), word_hashes(text_col).alias("h"))
    sizes = sorted(total["sizes"])
    if not sizes:
        return best_of(agreed(texts.where("false").select("*", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.col("h").alias("item_h"), F.lit(0).alias("low"), F.lit(0).alias("at")), threshold))
    sown, used = sown_seeds(items, sizes, threshold, masks)
    margin = min(piece_words, max([*map(len, used), *sizes]))
    few = total["words"] <= max_broadcast and sown.limit(max_broadcast + 1).count() <= max_broadcast
    starts = positions(pieces(texts, margin, min(map(len, used))), used)
    named = items.select(F.col("no").alias("n"), "item", F.col("h").alias("item_h"))
    if few:
        hits = starts.join(F.broadcast(sown), "seed").withColumn("at", F.col("at") - F.col("item_at"))
        near = hits.join(F.broadcast(named.where(F.size("item_h") <= margin)), F.col("no") == F.col("n"))
        found = agreed(near, threshold)
        if sizes[-1] <= margin:
            return best_of(found)
        far = hits.join(F.broadcast(named.where(F.size("item_h") > margin).select("n")), F.col("no") == F.col("n"))
    else:
        # text seeds that repeat by the million are split by the adaptive skew join: the other side has a row for each place of an item
        far = starts.select("id", "text_key", "low", "at", "seed").join(sown, "seed").withColumn("at", F.col("at") - F.col("item_at"))
    lines = far.select(F.col("id").alias("i"), F.col("text_key").alias("k"), "no", (F.col("low") + F.col("at")).alias("at"), F.lit(0).alias("low")).distinct()
    lines = lines.join(named, F.col("no") == F.col("n"))
    whole = agreed(texts.join(lines, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))), threshold)
    return best_of(found.unionByName(whole) if few else whole)


def best_of(hits: DataFrame) -> DataFrame:
    best = hits.groupBy("id", "text_key", "item").agg(F.max(F.struct(F.col("n_matched") / F.col("item_words"), "n_matched", "item_words", -F.col("start"))).alias("b"))
    return best.select("id", "text_key", "item", F.col("b.item_words").cast("long").alias("item_words"), F.col("b.n_matched").cast("long").alias("n_matched"), (-F.col("b.col4")).cast("long").alias("start"), F.col("b.col1").alias("overlap"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **params) -> DataFrame:
    found = leaks(docs, benchmark, id_col, text_col, item_col, **params)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "item_words", "n_matched", "start", "overlap")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns."""
    found = leaks(docs, benchmark, id_col, text_col, **params)
    own = free_names(docs, "id", "key")
    found = found.select(F.col("id").alias(own[0]), F.col("text_key").alias(own[1])).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(own[0])) & (F.xxhash64(text_col) == F.col(own[1])), "left_anti")
