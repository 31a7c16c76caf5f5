"""Which columns identify the same person: overlap of normalised value sets.

All id and name columns of all tables become one long (column, kind, key) table; one
aggregation by key gives a counter for each column that holds it, and from these come
every column's totals, every pair's overlap and the keys that only one of a pair has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import header_kind
from ..sources.reader import Table

EXAMPLES = 5


@dataclass
class Candidates:
    rows: list[dict]
    recommendation: dict | None


def key_columns(tables: list[Table]) -> list[tuple[int, int, str]]:
    """(table, place, kind) of the columns that can identify someone."""
    kinds = [(t, c, header_kind(h)) for t, table in enumerate(tables) for c, h in enumerate(table.info.headers)]
    return [x for x in kinds if x[2] in ("id", "name")]


def key_counts(tables: list[Table], columns: list[tuple[int, int, str]], exact: bool = True) -> DataFrame:
    """(kind, key, n): for each key, its cells in each column, by the column's place in ``columns``; blank cells have a null key.

    Each table is read once. One exchange by key, combined before it: a key's row has a
    counter for each column, so nothing grows with the number of its rows.
    """
    out = None
    for t in dict.fromkeys(x[0] for x in columns):
        own = [(i, c, k) for i, (u, c, k) in enumerate(columns) if u == t]
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.col(f"`{tables[t].info.headers[c]}`").alias("raw")) for i, c, k in own])).alias("x")
        part = tables[t].df.select(cells).select("x.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no id or name column in any table")
    text, key = (C.norm_text_exact, C.norm_key_exact) if exact else (C.norm_text, C.norm_key)
    out = out.withColumn("raw", text(F.col("raw")))
    keyed = F.when(F.col("kind") == "id", key(F.col("raw"), "id")).otherwise(key(F.col("raw"), "name"))
    out = out.select("i", "kind", F.when(F.col("raw") != "", keyed).alias("key"))
    counts = [F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(len(columns))]
    return out.groupBy("kind", "key").agg(*counts).select("kind", "key", F.array(*[f"n{i}" for i in range(len(columns))]).alias("n"))


def column_pairs(columns: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Columns of one kind in different tables, by their places in ``columns``."""
    every = list(enumerate(columns))
    return [(i, j) for i, a in every for j, b in every[i + 1 :] if a[0] < b[0] and a[2] == b[2]]


def overlaps(counts: DataFrame, columns: list[tuple[int, int, str]]) -> DataFrame:
    """A row for each pair of columns with counts only (ratios come from counts): (i, j, a_n, a_uniques, a_nulls, b_n, ..., overlap)."""
    pairs = column_pairs(columns)
    # what each key adds to the totals of its columns (i, i) and of pairs of them (i, j)
    held = F.filter(F.transform("n", lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda x: x["n"] > 0)
    met = counts.select(F.col("key").isNull().alias("blank"), held.alias("held"))
    met = met.select("blank", "held", F.posexplode("held").alias("p", "a"))
    met = met.select("blank", "a", F.explode(F.when(F.col("blank"), F.array("a")).otherwise(F.expr("slice(held, p + 1, size(held))"))).alias("b"))
    sums = met.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count_if(~F.col("blank")).alias("keys"), F.sum(F.when(~F.col("blank"), F.col("a.n")).otherwise(0)).alias("cells"), F.sum(F.when(F.col("blank"), F.col("a.n")).otherwise(0)).alias("blanks"))
    # a row for each pair of columns; as one map, so that both ends are looked up without computing it again
    totals = sums.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "i", "j"), F.struct("keys", "cells", "blanks")))).alias("m"))
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]) if pairs else F.array().cast("array<struct<i:int,j:int>>"))

    def total(i: str, j: str, what: str) -> Column:
        return F.coalesce(F.try_element_at("m", F.concat_ws("-", i, j))[what], F.lit(0)).cast("long")

    ends = [total(e, e, what).alias(f"{side}_{name}") for side, e in (("a", "i"), ("b", "j")) for name, what in (("n", "cells"), ("uniques", "keys"), ("nulls", "blanks"))]
    return totals.select("m", listed.alias("x")).select("m", "x.*").select("i", "j", *ends, total("i", "j", "keys").alias("overlap")).where("a_n > 0 AND b_n > 0")


def only_examples(counts: DataFrame, columns: list[tuple[int, int, str]]) -> DataFrame:
    """(i, j, rank, key): for each pair of columns, either way round, the first EXAMPLES keys, by code point, of column i that j lacks.

    The rank limit is applied before the exchange too, so a pair sends EXAMPLES keys a task.
    """
    pairs = [x for i, j in column_pairs(columns) for x in ((i, j), (j, i))]
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]) if pairs else F.array().cast("array<struct<i:int,j:int>>")
    lone = F.filter(listed, lambda x: (F.get("n", x["i"]) > 0) & (F.get("n", x["j"]) == 0))
    rows = counts.where("key IS NOT NULL").select("key", F.explode(lone).alias("x")).select("x.*", "key")
    rank = F.row_number().over(Window.partitionBy("i", "j").orderBy("key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= EXAMPLES).select("i", "j", "rank", "key")


def suggest(tables: list[Table]) -> Candidates:
    """Scored candidates, best first, and a recommendation."""
    columns = key_columns(tables)
    counts = key_counts(tables, columns).persist()
    lone: dict[tuple[int, int], list[str]] = {}
    for r in only_examples(counts, columns).orderBy("i", "j", "rank").collect():  # EXAMPLES rows for each pair of columns
        lone.setdefault((r.i, r.j), []).append(r.key)
    out = []
    for r in overlaps(counts, columns).collect():  # a row for each pair of columns
        (t, p, kind), (u, q, _) = columns[r.i], columns[r.j]
        a, b = tables[t], tables[u]
        union = r.a_uniques + r.b_uniques - r.overlap
        stats = {
            "a_unique": r.a_uniques,
            "b_unique": r.b_uniques,
            "overlap": r.overlap,
            "overlap_rate_vs_a": round(r.overlap / r.a_uniques, 4),
            "overlap_rate_vs_b": round(r.overlap / r.b_uniques, 4),
            "jaccard": round(r.overlap / union, 4),
        }
        dups = {"a": r.a_n - r.a_uniques, "b": r.b_n - r.b_uniques}
        unique = 1.0 - (dups["a"] / r.a_n + dups["b"] / r.b_n) / 2.0
        score = round(0.6 * min(stats["overlap_rate_vs_a"], stats["overlap_rate_vs_b"]) + 0.25 * stats["jaccard"] + 0.15 * unique, 4)
        ends = {"a_file": a.info.file, "a_col": a.info.headers[p], "a_kind": kind, "b_file": b.info.file, "b_col": b.info.headers[q], "b_kind": kind}
        x = ends | {"score": score, "stats": stats, "nulls": {"a": r.a_nulls, "b": r.b_nulls}, "dup_keys": dups}
        x["evidence"] = evidence(x, lone.get((r.i, r.j), []), lone.get((r.j, r.i), []))
        out.append((-score, a.info.file, a.info.headers[p], t, u, p, q, x))
    counts.unpersist()
    found = [x[-1] for x in sorted(out, key=lambda x: x[:-1])]
    return Candidates(found, recommend(found))


def evidence(x: dict, a_only: list[str], b_only: list[str]) -> str:
    s = x["stats"]
    text = f"“{x['a_file']}”[{x['a_col']}] 与 “{x['b_file']}”[{x['b_col']}] 清洗后：A 侧 {s['overlap']}/{s['a_unique']} 对上（{s['overlap_rate_vs_a'] * 100:.1f}%），B 侧 {s['overlap']}/{s['b_unique']} 对上（{s['overlap_rate_vs_b'] * 100:.1f}%）"
    notes = [
        any(x["nulls"].values()) and f"空值 A={x['nulls']['a']}/B={x['nulls']['b']}",
        any(x["dup_keys"].values()) and f"重复键 A={x['dup_keys']['a']}/B={x['dup_keys']['b']}（疑似重名或重复行）",
        (a_only or b_only) and f"疑似差异示例 A 独有{a_only[:3]} / B 独有{b_only[:3]}",
    ]
    return "；".join([text, *filter(None, notes)])


def recommend(candidates: list[dict]) -> dict | None:
    if not candidates:
        return None
    top, leading = candidates[0], {c[k] for c in candidates[:3] for k in ("a_kind", "b_kind")}
    text = f"首选：{top['evidence']}。推荐用“{'工号类' if top['a_kind'] == 'id' else '姓名类'}”列互相比对；"
    if any(top["dup_keys"].values()):
        text += "注意存在重复键，合并后请核对“表内重复键”清单；"
    better = "id" in leading and top["a_kind"] == "name"
    text += "检测到工号类列，若姓名有一致率短板请优先改用工号。" if better else "确认无误后即可写入 plan.json 执行合并。"
    return {"text": text, "top": {k: top[k] for k in ("a_file", "a_col", "b_file", "b_col")}}


def ranked(pairs: DataFrame) -> DataFrame:
    """Scores and ranks of ``overlaps`` rows as columns; half a unit of the last digit rounds up, however it is stored (``suggest`` rounds what is stored)."""
    ra, rb = (F.bround(F.col("overlap") / F.col(u), 4) for u in ("a_uniques", "b_uniques"))
    jaccard = F.bround(F.col("overlap") / (F.col("a_uniques") + F.col("b_uniques") - F.col("overlap")), 4)
    unique = 1 - ((F.col("a_n") - F.col("a_uniques")) / F.col("a_n") + (F.col("b_n") - F.col("b_uniques")) / F.col("b_n")) / 2
    score = 0.6 * F.least(ra, rb) + 0.25 * jaccard + 0.15 * unique
    scored = pairs.withColumn("score", F.floor(score * 10000 + 0.5000001) / 10000)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "i", "j")))
