"""Near duplicates by consistent weighted sampling.

Texts are cut into shingles of five words. A shingle weighs its count in the text times
the mean inverse document frequency of its words; word frequencies are counted over all
documents, in a hashed vocabulary of fixed size (so what is broadcast doesn't grow). Each
text gets ``bands * rows`` improved consistent weighted samples; texts that agree on all
samples of a band (or of two or three neighbouring bands) are compared with a few of that
group, its pivots; pairs are verified by weighted Jaccard similarity of the whole shingle
sets, and verified pairs are joined into classes.

Equal texts are one node from the start. A group of n texts gives at most n pairs for
each pivot, so no group is expanded into all pairs. A group is settled once all its
members are in one class; until then its other members, linked or not, meet more pivots,
as many in each round as ``pivots`` says: of a large group of copies nearly all are then in
one class. A round that settles few rows is the last, as its groups are of texts that
are no near copies. What is left goes to an exact prefix-filter join, so every pair that shares a
band is in one class, verified, or bound to be below the threshold. Of its pairs each text's
nearest are verified first, then those that still lie between two classes. Rows of a crowded key
meet its pivots only, so the adaptive skew join may split them.
Sampling finds a pair at the threshold in a band with probability 0.64 and in one of
twelve with 0.999995; tests measure recall of classes against brute force.

Defined results: a text without words (null, empty, white space) is a class of its own
unless its id has one; texts of fewer than five words are one shingle; repeated rows and
equal texts share a class; a null id stands for no document: its row gets a class by its
text (the smallest id of it, or null); different texts under one id are searched and
classed each for itself, and of near copies under one id one is kept; texts of any length
are read whole; an empty table gives an empty one; other columns are not read, and are
kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import mix
from .common import discard, free_names, passing, staged, tidy
from .components import components

WORD = re.compile(r"[^\W_]+")
#: Buckets of the hashed vocabulary whose document frequencies are counted.
VOCABULARY = 1 << 18
SHINGLE = 5
#: Weights are kept in steps of 1 / SCALE.
SCALE = 8
CACHE_WORDS = 400_000
#: Buckets in which the exact join counts shingles.
PLACES = 1 << 20
#: Members of one class in one list of the exact join.
LIST = 2000
#: Buckets of a text's shingles by which the exact join bounds what two texts share.
SPREAD = 256
#: Partners of a text that the exact join's pairs are verified with first.
NEAREST = 4
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), U, len(words))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(46)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Documents that have a word of each bucket, and at the end the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[np.unique(bucket(word_hashes(text)))] += 1
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["b", "n"])

    with passing(docs.sparkSession):
        found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCABULARY + 1, np.int64)
    out[found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def inverse_frequencies(counts: np.ndarray) -> np.ndarray:
    return (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1).astype(np.float32)


def shingles(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their weights in steps."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k = min(n, SHINGLE)
    weights = idf[bucket(hashes)]
    h, w = hashes[: n - k + 1] * U(3), weights[: n - k + 1].copy()
    for i in range(1, k):
        h = h * GOLDEN + hashes[i : n - k + 1 + i]
        w += weights[i : n - k + 1 + i]
    h, first, count = np.unique(mix(h), return_index=True, return_counts=True)
    return h, np.maximum(1, np.rint(w[first] / k * SCALE * count)).astype(np.int64)


class Sampler:
    """Improved consistent weighted samples, with the random draws of a shingle looked up.

    A shingle's r and c, both Gamma(2, 1), and its uniform beta for sample i are picked
    from fixed tables of draws by the bits of a hash of the shingle and i.
    """

    BITS = 16

    def __init__(self, samples: int, seed: int = 1) -> None:
        draw = np.random.default_rng(seed)
        n = 1 << self.BITS
        self.r = draw.gamma(2, 1, n).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, n)).astype(np.float32)
        self.beta = draw.random(n).astype(np.float32)
        self.samples = samples

    def sample(self, h: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of samples for each text; ``h`` and ``w`` hold the texts' shingles one after another."""
        low = U((1 << self.BITS) - 1)
        log_w = np.log(w.astype(np.float32))
        begin = np.cumsum(sizes) - sizes
        out = np.zeros((len(sizes), self.samples), U)
        for i in range(self.samples):
            z = mix(h + U((i + 1) * int(GOLDEN) & (1 << 64) - 1))
            r = self.r[(z & low).astype(np.intp)]
            beta = self.beta[((z >> U(16)) & low).astype(np.intp)]
            t = np.floor(log_w / r + beta)
            cost = self.log_c[((z >> U(32)) & low).astype(np.intp)] - r * (t - beta + 1)
            least = np.minimum.reduceat(cost, begin)
            at = np.flatnonzero(cost == np.repeat(least, sizes))
            at = at[np.searchsorted(at, begin)]
            out[:, i] = mix(h[at] + mix(t[at].astype(np.int64).astype(U) + U(i)))
        return out


def packed(h: np.ndarray, w: np.ndarray) -> bytes:
    """A weighted set in eight bytes a shingle: 48 bits of hash, 16 of weight; heavier ones take more entries."""
    top = h >> U(16)
    while (w > 65535).any():
        over = w > 65535
        again = mix(h[over] + U(1))
        h, top, w = np.append(h, again), np.append(top, again >> U(16)), np.append(np.minimum(w, 65535), w[over] - 65535)
    return np.sort(top << U(16) | w.astype(U)).astype("<u8").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, and their weights."""
    both = np.frombuffer(data, "<u8")
    return (both >> U(16)).astype(np.int64), (both & U(65535)).astype(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    (x, wx), (y, wy) = unpacked(a), unpacked(b)
    keys, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    wx, wy = np.bincount(at[: len(x)], wx, len(keys)), np.bincount(at[len(x) :], wy, len(keys))
    most = np.maximum(wx, wy).sum()
    return float(np.minimum(wx, wy).sum() / most) if most else 0.0


def spreads(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each set by bucket, in units rounded up to two bytes, and the unit, 1 where they fit; the lists repeat them for each shingle."""
    rows = np.zeros((len(sets), SPREAD))
    for row, (e, w) in zip(rows, map(unpacked, sets)):
        row += np.bincount(e % SPREAD, w, SPREAD)
    units = np.maximum(1.0, rows.max(1, initial=0) / 32767)
    # what rounding takes from a quotient at the limit is put on the unit
    units[units > 1] *= 1 + 1e-9
    return np.ceil(rows / units[:, None]).astype(np.int16), units


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of single bands, of two neighbouring bands and of three."""
    h = np.zeros((len(samples), bands), U)
    for i in range(rows):
        h = mix(h * GOLDEN + samples.reshape(len(samples), bands, rows)[:, :, i] + np.arange(bands, dtype=U)[None, :])
    two = mix(h * GOLDEN + np.roll(h, -1, axis=1))
    three = mix(two * GOLDEN + np.roll(h, -2, axis=1))
    return np.concatenate([h, two, three], axis=1).astype(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(id, key, weight, keys) of each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = shared.value, Sampler(bands * rows)

        def out(ids: list, keys: list, sets: list) -> pa.RecordBatch:
            sizes = np.array([len(h) for h, _ in sets])
            full = np.flatnonzero(sizes)
            codes = np.zeros((len(sets), 3 * bands), np.int64)
            if len(full):
                s = sampler.sample(np.concatenate([sets[i][0] for i in full]), np.concatenate([sets[i][1] for i in full]), sizes[full])
                codes[full] = band_keys(s, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array([int(w.sum()) for _, w in sets], pa.int64()), lists],
                ["id", "key", "weight", "keys"],
            )

        for batch in batches:
            ids, keys, sets, held = [], [], [], 0
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                keys.append(key)
                sets.append(shingles(word_hashes(text), idf))
                held += len(sets[-1][0])
                if held > 50_000:
                    yield out(ids, keys, sets)
                    ids, keys, sets, held = [], [], [], 0
            if ids:
                yield out(ids, keys, sets)

    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(run, "id long, key string, weight long, keys array<long>")


def weighted_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, idf: np.ndarray) -> DataFrame:
    """(node, packed) of the wanted (node, key) rows; texts are shuffled compressed."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            blobs = [press((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["id", "key", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets = [packed(*shingles(word_hashes(unpack(b).decode("utf-8", "surrogatepass")), shared.value)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "packed"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    # repeated rows are one
    texts = texts.mapInArrow(pack, "id long, key string, blob binary").groupBy("id", "key").agg(F.first("blob").alias("blob"))
    met = texts.join(nodes.select("node", "least_id", F.col("key").alias("k")), (F.col("id") == F.col("least_id")) & (F.col("key") == F.col("k"))).select("node", "blob")
    return met.mapInArrow(run, "node long, packed binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok) of pairs whose weights allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard(x, y) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    left = sets.select(F.col("node").alias("n"), F.col("packed").alias("pa"))
    right = sets.select(F.col("node").alias("m"), F.col("packed").alias("pb"))
    met = pairs.join(left, F.col("a") == F.col("n")).join(right, F.col("b") == F.col("m"))
    return met.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long, ok boolean")


def prefix_pairs(left: DataFrame, sets: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """(a, b, most) of all members that share a band, can reach the threshold and aren't in one class, by an exact prefix filter.

    A set's shingles are put into one global order, rarest first. Of two sets at the
    threshold t, what they share weighs t of the heavier one and 2t / (1 + t) of the
    lighter one at least, and all of it comes from the first shared shingle on. So that
    shingle is in the heavier set's prefix (up to 1 - t of its weight) and in the lighter
    one's shorter one. Texts that only have a passage in common don't meet by it, unless
    it is so much of both that they are near copies, which then are in one class: members
    of one class are kept in a list, and what a list can share at most is looked at before
    its members are. Frequencies are counted in hashed buckets; they only decide on the
    order, so nothing depends on their precision. Two texts share at most the lesser weight
    of each bucket of their shingles (``most``, as a part of both weights), which tells
    variants of one text apart that are not quite near copies, of which the prefixes can't
    tell much.
    """
    nodes = left.groupBy("node").agg(F.min("root").alias("root")).withColumnRenamed("node", "n")
    wanted = staged(sets.join(nodes, F.col("node") == F.col("n")).select("node", "root", "packed"), "wanted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for packed_ in batch.column(0).to_pylist():
                total[np.unique(unpacked(packed_)[0] % PLACES)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["b", "n"])

    with passing(wanted.sparkSession):
        found = wanted.select("packed").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(PLACES, np.int32)
    often[found["b"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    shared = left.sparkSession.sparkContext.broadcast(often)

    short = 2 * threshold / (1 + threshold)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for node, root, packed_ in zip(*(c.to_pylist() for c in batch.columns)):
                e, w = unpacked(packed_)
                e, at = np.unique(e, return_inverse=True)
                w = np.bincount(at, w)
                order = np.lexsort((e, shared.value[e % PLACES]))
                total, rest = w.sum(), np.cumsum(w[order][::-1])[::-1]
                n = int((rest >= threshold * total - 1e-6).sum())
                for col, v in zip(cols, ([node] * n, [root] * n, [total] * n, e[order][:n].tolist(), rest[:n].tolist(), (rest[:n] >= short * total - 1e-6).tolist())):
                    col.extend(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["node", "root", "w", "e", "rest", "short"])

    firsts = staged(wanted.mapInArrow(prefix, "node long, root long, w double, e long, rest double, short boolean"), "firsts")

    # most are of one text; only those by which two classes can meet are looked at further
    shared = firsts.groupBy(F.col("e").alias("e_")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("short").alias("any")).where("lo < hi AND any").select("e_")
    every, firsts = firsts, staged(firsts.join(shared, F.col("e") == F.col("e_")).select("node", "root", "w", "e", "rest", "short"), "shared")
    discard(every)
    read = wanted, firsts
    # a text's shingles of these in the global order, to tell a pair's first common one; lists of a class are cut into bounded ones

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = spreads(batch.column(1).to_pylist())
            ends = np.arange(0, rows.size + 1, SPREAD)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(units, pa.float64())], ["o", "spread", "unit"])

    at = F.struct((-F.col("rest")).alias("at"), "e")
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["e"])
    whole = firsts.groupBy(F.col("node").alias("m")).agg(in_order(at).alias("prefix"), in_order(F.when(F.col("short"), at)).alias("shorter"))
    whole = whole.join(bands.select(F.col("node").alias("o"), "bands"), F.col("m") == F.col("o")).drop("o")
    whole = whole.join(wanted.select("node", "packed").mapInArrow(spread, "o long, spread array<short>, unit double"), F.col("m") == F.col("o")).drop("o")
    firsts = firsts.join(whole, F.col("node") == F.col("m"))

    def lists(rows: DataFrame, side: str, prefix: str) -> DataFrame:
        sizes = rows.groupBy(F.col("e").alias("e_"), F.col("root").alias("r_")).agg(F.count("*").alias("size"))
        met = rows.join(sizes, (F.col("e") == F.col("e_")) & (F.col("root") == F.col("r_")))
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / LIST))
        held = F.collect_list(F.struct("node", "w", "rest", "bands", "spread", "unit", F.col(prefix).alias("prefix"))).alias(f"{side}_held")
        return met.groupBy(F.col("e").alias(f"{side}_e"), F.col("root").alias(f"{side}_root"), part.alias("part")).agg(held, F.max("rest").alias(f"{side}_rest"), F.min("w").alias(f"{side}_w")).drop("part")

    c = threshold / (1 + threshold)
    met = lists(firsts, "x", "prefix").join(lists(firsts.where("short"), "y", "shorter"), F.col("x_e") == F.col("y_e"))
    met = met.where((F.col("x_root") != F.col("y_root")) & (F.least("x_rest", "y_rest") >= c * (F.col("x_w") + F.col("y_w")) - 1e-6))
    # the heavier one is x, of equal ones that with the larger number; a pair comes from its first common shingle only
    fits = (
        f"(x.w > y.w OR x.w = y.w AND x.node > y.node) AND y.w >= {threshold} * x.w - 1e-6"
        f" AND least(x.rest, y.rest) >= {c} * (x.w + y.w) - 1e-6 AND array_intersect(x.prefix, y.prefix)[0] = x_e"
        " AND arrays_overlap(x.bands, y.bands)"
    )
    most = "aggregate(zip_with(x.spread, y.spread, (p, q) -> least(p * x.unit, q * y.unit)), 0D, (s, v) -> s + v) / (x.w + y.w)"
    # the larger number first, as in the rounds
    found = f"transform(filter(x_held, x -> {fits}), x -> struct(greatest(x.node, y.node) AS a, least(x.node, y.node) AS b, {most} AS most))"
    pairs = F.expr(f"flatten(transform(y_held, y -> filter({found}, z -> z.most >= {c - 1e-6})))")
    out = staged(met.select(F.explode(pairs).alias("p")).select("p.a", "p.b", "p.most").groupBy("a", "b").agg(F.max("most").alias("most")), "met")
    discard(*read)
    return out


def nearest(pairs: DataFrame) -> DataFrame:
    """(a, b) of each text's pairs that may share most, a few for each text."""
    ends = [pairs.withColumn("nth", F.row_number().over(Window.partitionBy(c).orderBy(F.desc("most"), "a", "b"))).where(F.col("nth") <= NEAREST) for c in "ab"]
    return ends[0].select("a", "b").union(ends[1].select("a", "b")).distinct()


def between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) of pairs that the edges leave in two classes."""
    roots = components(edges)
    for c in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")), F.col(c) == F.col(f"{c}_node"), "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def one_key(left: DataFrame) -> DataFrame:
    """(k, node, root, weight) with the most crowded key of each text."""
    sizes = left.groupBy(F.col("k").alias("key_")).agg(F.count("*").alias("size"))
    met = left.join(sizes, F.col("k") == F.col("key_"))
    return met.groupBy("node", "root", "weight").agg(F.max(F.struct("size", "k")).alias("m")).select("m.k", "node", "root", "weight")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 12, rows: int = 2, pivots: tuple[int, ...] = (1, 8, 8, 8)) -> DataFrame:
    """(id, key, class_id, n_links, head): a row for each input row; ``key`` is the text's digest, ``head`` says if it is the class's first text."""
    idf = inverse_frequencies(document_frequencies(docs, text_col))
    sketched = staged(sketch(docs, id_col, text_col, idf, bands, rows), "sketch")
    # one node for each text, whatever its ids; nodes are numbered, and the numbers say nothing of ids
    names = sketched.groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    nodes = staged(names.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # rows of one text are alike but for their ids; the one with the smallest id is read
    first = sketched.where("weight > 0").join(nodes.where("least_id IS NOT NULL").select("key", "node", "least_id"), "key").where(F.col("id") == F.col("least_id"))
    members = staged(first.groupBy("node").agg(*[F.first(c).alias(c) for c in ("key", "weight", "keys", "least_id")]), "members")
    # most texts agree with no other in any band; only the others' keys of two and three bands are looked at
    single = members.select("node", F.explode(F.array_distinct(F.slice("keys", 1, bands))).alias("k"))
    shared = single.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("key_"))
    crowded = single.join(shared, F.col("k") == F.col("key_")).select("node").distinct().withColumnRenamed("node", "n")
    every, members = members, staged(members.join(crowded, F.col("node") == F.col("n"), "left_semi"), "crowded")
    discard(every)
    # the end reads no keys of bands
    wide, sketched = sketched, staged(sketched.select("id", "key", "weight"), "rows")
    discard(wide)
    keyed = members.select("node", "weight", F.explode(F.array_distinct("keys")).alias("k"))
    crowd = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("key_"))
    left = staged(keyed.join(crowd, F.col("k") == F.col("key_")).select("k", "node", F.col("node").alias("root"), "weight"), "left")
    edges, done = None, None
    sets = staged(weighted_sets(docs, members, id_col, text_col, idf), "sets")
    n, rows_left = 0, left.count()
    tidy(docs.sparkSession)
    while True:
        last = n == len(pivots)
        if last:
            pairs = prefix_pairs(left, sets, members.select("node", F.slice("keys", 1, bands).alias("bands")), threshold)
        else:
            # first all keys; then each text's most crowded one, as what is left of large groups shares most keys
            keys = left if not n else one_key(left)
            # by a hash that changes, so that they aren't always the same texts; the limit is applied before the exchange too
            nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(n), "node"), "node"))
            heads = keys.withColumn("nth", nth).where(F.col("nth") <= pivots[n])
            heads = staged(heads.select(F.col("k").alias("key_"), F.col("node").alias("pivot"), F.col("root").alias("pivot_root"), F.col("weight").alias("pivot_weight")), "pivots")
            # a bound, not an estimate: the smaller weight is the most that two sets share
            fits = F.least("weight", "pivot_weight") >= threshold * F.greatest("weight", "pivot_weight")
            met = keys.join(heads, F.col("k") == F.col("key_")).where("node <> pivot AND root <> pivot_root").where(fits)
            pairs = met.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        read = [pairs]
        if last:
            tidy(docs.sparkSession)
            # members of a large group have many pairs, of which few are enough to make it one class
            near = staged(nearest(pairs), "near")
            new = staged(verified(near, sets, threshold), "nearest").where("ok").select("a", "b")
            edges = new if edges is None else edges.unionByName(new)
            pairs = staged(between(pairs.join(near, ["a", "b"], "left_anti"), edges), "between")
            read += [near, pairs]
        judged = staged(verified(pairs, sets, threshold), "judged")
        discard(*read)
        new = judged.where("ok").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        if last:
            break
        seen = judged.select("a", "b")
        done = seen if done is None else done.unionByName(seen)
        # the first pivots are settled; a group goes on until all its other members are in one class
        roots = components(edges).select(F.col("node").alias("n"), F.col("root").alias("new_root"))
        rest = left if n else left.join(heads, (F.col("k") == F.col("key_")) & (F.col("node") == F.col("pivot")), "left_anti")
        labelled = staged(rest.join(roots, F.col("node") == F.col("n"), "left").select("k", "node", F.coalesce("new_root", "node").alias("root"), "weight"), "labelled")
        discard(left, heads)
        mixed = labelled.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("k").alias("key_"))
        left = staged(labelled.join(mixed, F.col("k") == F.col("key_")).select("k", "node", "root", "weight"), "left")
        discard(labelled)
        tidy(left.sparkSession)
        before, rows_left = rows_left, left.count()
        if not rows_left:
            break
        n = n + 1 if not n or rows_left < 0.9 * before else len(pivots)
    discard(sets, members, left)
    tidy(docs.sparkSession)
    edges = staged(edges.distinct(), "links")
    roots = components(edges).select(F.col("node").alias("n"), "root")
    links = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("l")).agg(F.count("*").alias("links"))
    named = nodes.join(roots, F.col("node") == F.col("n"), "left").join(links, F.col("node") == F.col("l"), "left")
    named = named.select(F.col("key").alias("k"), F.coalesce("root", "node").alias("root"), "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = staged(named, "named")
    # a class goes by its smallest id; of texts that tie at it, the one with the smallest digest is its first
    heads = named.groupBy(F.col("root").alias("r")).agg(F.min(F.when(F.col("least_id").isNotNull(), F.struct("least_id", "k"))).alias("head"))
    named = named.join(heads, F.col("root") == F.col("r")).select("k", "n_links", F.col("head.least_id").alias("class"), F.col("head.k").alias("head_key"))
    out = sketched.select("id", "key", "weight").join(named, F.col("key") == F.col("k"))
    blank = F.col("weight") == 0
    return out.select(F.col("id").alias(id_col), "key", F.when(blank, F.col("id")).otherwise(F.col("class")).alias("class_id"), F.when(blank, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), (blank | (F.col("key") == F.col("head_key"))).alias("head"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each class, with its own columns: the one with the smallest id."""
    found = classes(docs, id_col, text_col, **params)
    own = free_names(docs, "id", "key")
    gone = found.where((F.col(id_col) != F.col("class_id")) | ~F.col("head")).select(F.col(id_col).alias(own[0]), F.col("key").alias(own[1])).distinct()
    return docs.join(gone, (F.col(id_col) == F.col(own[0])) & (text_key(F.col(text_col)) == F.col(own[1])), "left_anti")
