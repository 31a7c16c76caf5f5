"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector shared by all ordered
thresholds. Features are the hashed distinct words of a text. An L1 penalty (proximal
gradient steps) picks the features, so that words that carry no severity get exactly no
weight and long clean documents gather no noise.

Labels are 0 or 1. Grades above 1 come from the same labelled rows: a first fit with one
threshold finds the words that speak for the label, and labelled-toxic rows are graded
1, 2 or 3 by how many places of the text those words take (terciles). The fit sees at
most ``max_fit_rows`` labelled rows (the smallest seeded hashes), and of each the
distinct features of the whole text; the bound holds for what the driver is sent, too.

Defined results: a null or empty text has no features and gets the grade of the
intercepts; texts of any length are read whole; a null label is no label, and of labels
that tie the greatest counts; of different texts under one labelled id the fit sees the
smallest; repeated rows give repeated results; with no toxic label at all, or none but
toxic ones, there is nothing to tell them by and nothing is rejected; an empty table
gives an empty one; other columns are not read by ``grade`` and are kept by
``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing

#: Hashed features; the model has this many weights whatever the corpus.
BITS = 18
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 500_000


def hashed(word: str) -> tuple[int, ...]:
    """The features of a word: itself, and its first four and five letters if it is longer."""
    names = [word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in names)


def features(text: str | None, cache: dict[str, tuple[int, ...]]) -> dict[int, int]:
    """Feature -> places, over the whole text; ``cache`` maps words to features."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    out: dict[int, int] = {}
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        found = cache.get(word)
        if found is None:
            found = cache[word] = hashed(word)
        for f in found:
            out[f] = out.get(f, 0) + n
    return out


@dataclass
class Model:
    features: np.ndarray  # of the weights that aren't 0, ascending
    weights: np.ndarray
    thetas: np.ndarray  # ascending

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """w.x of whole texts; words without a weighted feature cost one look-up."""
        table = dict(zip(self.features.tolist(), self.weights.tolist()))
        cache: dict[str, tuple[int, ...]] = {}
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                fs = cache.get(word)
                if fs is None:
                    fs = cache[word] = tuple(f for f in hashed(word) if f in table)
                if fs:
                    found.update(fs)
            out[i] = sum(table[f] for f in sorted(found))
            if len(cache) > CACHE_WORDS:
                cache.clear()
        return out

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thetas[None, :], -40, 40)))


def descend(row: np.ndarray, column: np.ndarray, n: int, m: int, target: np.ndarray, l1: np.ndarray | float, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient on the mean loss."""
    top = target.shape[1]
    share = np.clip(target.mean(0), 1e-4, 1 - 1e-4)
    thetas = np.log(1 / share - 1)
    # the largest curvature, by power iteration on the columns' Gram matrix
    x = np.ones(m)
    big = 1.0
    for _ in range(12 if m else 0):
        x = np.bincount(column, np.bincount(row, x[column], minlength=n)[row], minlength=m)
        big = float(np.linalg.norm(x)) or 1.0
        x /= big
    step = 1 / (0.25 * top * big / n * 1.1 + l2)
    w = np.zeros(m)
    v, momentum = w.copy(), 1.0
    for _ in range(steps):
        score = np.bincount(row, v[column], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thetas[None, :], -40, 40)))
        error = p - target
        new = v - step * (np.bincount(column, error.sum(1)[row], minlength=m) / n + l2 * v)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
        thetas = np.sort(thetas + error.mean(0) / np.maximum((p * (1 - p)).mean(0), 0.02))
    return w, thetas


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, z: float = 6.0, min_rows: int = 5, l2: float = 2e-5, steps: int = 200) -> Model:
    """Cumulative-link logits; ``rows`` has each text's features.

    The L1 fit picks the features: each one's penalty is ``z`` times the spread that its
    gradient would have by chance, so rare and frequent features face one test. A second
    fit on these alone, with a small ridge, takes the shrinkage back.
    """
    top, n = int(grades.max(initial=0)), len(rows)
    none = Model(np.zeros(0, np.int64), np.zeros(0), np.full(1, 40.0))
    if not top or not sum(map(len, rows)):
        return none
    target = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    share = target.mean(0)
    # rows are counted one by one, as copies of them all would take most of the driver's memory
    size = 1 + max(int(r.max()) for r in rows if len(r))
    often, slope = np.zeros(size, np.int64), np.zeros(size)
    for r, x in zip(rows, (share[None, :] - target).sum(1)):
        often[r] += 1
        slope[r] += x
    l1 = z * np.sqrt(often * (share * (1 - share)).sum()) / n
    # features of too few rows go first; one whose first gradient is under half its penalty won't be picked, and leaving it out keeps the fit small
    picked = (often >= min_rows) & (np.abs(slope) / n > 0.5 * l1)
    names, l1 = np.flatnonzero(picked), l1[picked]
    place = (np.cumsum(picked) - 1).astype(np.int32)
    found = [place[r[picked[r]]] for r in rows]
    column = np.concatenate(found)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in found])
    del often, slope, place, found

    def only(wanted: np.ndarray) -> None:
        nonlocal names, column, row
        kept = wanted[column]
        column, row, names = (np.cumsum(wanted, dtype=np.int32) - 1)[column[kept]], row[kept], names[wanted]

    w, _ = descend(row, column, n, len(names), target, l1, 0.0, steps)
    only(np.abs(w) > 1e-9)
    if not len(names):
        return none
    w, thetas = descend(row, column, n, len(names), target, 0.0, l2, 3 * steps)
    return Model(names, w, thetas)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit_rows: int = 12_000, seed: int = 11) -> Model:
    """The model of a bounded sample of labelled rows; the bound holds at every size."""
    order = F.xxhash64(F.lit(seed), F.col("id"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    marked = marked.orderBy(order, "id").limit(max_fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id")
    # a row for each labelled id, however often documents repeat it
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [features(t, cache) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], ["id", "label", "f", "n"])

    with passing(docs.sparkSession):
        got = texts.select("id", "text", "label").mapInArrow(sparse, "id long, label int, f array<int>, n array<int>").toArrow()
    # views of what was sent, chunk by chunk
    y, f, n, values = got["label"].to_numpy(), [], [], None
    for out, name in ((f, "f"), (n, "n")):
        for chunk in got[name].chunks:
            at, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
            out.extend(values[at[i] : at[i + 1]] for i in range(len(chunk)))
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    rows, counts, toxic = [f[i] for i in order], [n[i] for i in order], (y[order] > 0).astype(int)
    model = fit_ordinal(rows, grades_of(rows, counts, toxic))
    # else Arrow keeps what it was sent for later tables
    del got, f, n, values, rows, counts
    pa.default_memory_pool().release_unused()
    return model


def grades_of(rows: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic ones 1 to 3 by terciles of the places their telling words take."""
    first = fit_ordinal(rows, toxic)
    telling = first.features[first.weights > 0]
    places = np.array([int(c[np.isin(r, telling)].sum()) if len(r) else 0 for r, c in zip(rows, counts)])
    if not toxic.any():
        return toxic
    cuts = np.quantile(places[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + (places[:, None] > cuts[None, :]).sum(1), 0)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, expected_severity, grade, p_toxic, rejected) of every row."""
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(scorer(model, threshold), f"{id_col} long, expected_severity double, grade int, p_toxic double, rejected boolean")


def scorer(model: Model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.above(model.scores(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(above.sum(1)), pa.array((above > 0.5).sum(1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= threshold)], ["id", "expected_severity", "grade", "p_toxic", "rejected"])

    return score


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns, in one narrow pass."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array(model.above(model.scores(texts))[:, 0] < threshold))

    return docs.mapInArrow(keep, docs.schema)
