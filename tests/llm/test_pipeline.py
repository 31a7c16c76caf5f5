"""Near-duplicate classes against brute force, and the pipeline stage by stage."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5
from pathlib import Path

import corpus_pipeline
import numpy as np
from keyloom.llm import neardup, queries
from keyloom.llm.components import components
from pyspark.sql import functions as F

from .test_text_scans import brute_leaks
from .util import ODD, SF, docs


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_on_the_driver_and_by_rounds(spark):
    """Few edges take few queries, however long their chains; more are solved by joins, with the same result."""
    r = random.Random(2)
    order = list(range(300))
    r.shuffle(order)
    edges = [*zip(order[:200], order[1:200]), *((r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, small):
        spark.sparkContext.setJobGroup(group, group)
        got = {x.node: x.root for x in components(table, small).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, len(tracker.getJobIdsForGroup(group))

    (few, n_few), (many, n_many) = jobs("on the driver", len(edges)), jobs("by rounds", len(edges) - 1)
    assert few == many and len(set(few[x] for x in order[:200])) == 1 and few[order[0]] == min(order[:200])
    assert n_few <= 6 < n_many


def test_nothing_is_left_on_disk(spark, monkeypatch):
    """Shuffle files go with their query, tables with their last reader, and the caller's settings stay."""
    from keyloom.llm import common

    at = f"{spark.conf.get('spark.checkpoint.dir')}/nothing-is-left"
    real, left = neardup.staged, []
    monkeypatch.setattr(common, "shared_dir", lambda spark: at)

    def told(df, name):
        out = real(df, name)
        left.append(sorted(x.name.rsplit("-", 1)[0] for x in Path(at.removeprefix("file://"), "keyloom").iterdir()))
        return out

    monkeypatch.setattr(neardup, "staged", told)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    before = blocks().size()
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[i % 7 :], f"x{i}"])) for i in range(60)]
    found = neardup.classes(docs(spark, rows))
    assert blocks().size() <= before + 8 and spark.conf.get(common.CLEANUP) == "false"
    kept = set(left[-1])
    assert {"rows", "nodes", "links", "named"} <= kept and not kept & {"sketch", "members", "crowded", "left", "labelled", "pivots", "pairs", "sets", "wanted", "firsts", "shared"}
    assert len({x.class_id for x in found.collect()}) == 1 and len(found.collect()) == 60


def test_spreads_are_bounds(spark):
    """Buckets of heavy sets are rounded up to two bytes, those of others are exact."""
    r = np.random.default_rng(5)
    sets = [(r.integers(0, 2**63, n).astype(np.uint64), r.integers(1, top, n)) for n, top in ((0, 9), (3000, 900), (200_000, 60_000))]
    rows, units = neardup.spreads([neardup.packed(*x) for x in sets])
    assert rows.dtype == np.int16 and rows.min() >= 0 and units[0] == units[1] == 1 and units[2] > 1
    for (h, w), row, unit in zip(sets, rows, units):
        exact = np.bincount(((h >> np.uint64(16)).astype(np.int64) % neardup.SPREAD), w, neardup.SPREAD)
        assert (row * unit >= exact - 1e-6).all() and (row * unit < exact + unit + 1e-6).all()


def brute_classes(rows, idf):
    sets = {}
    for i, text in rows:
        h, w = neardup.shingles(neardup.word_hashes(text), idf)
        sets[i] = dict(zip(h.tolist(), w.tolist()))
    shared = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            shared[h].append(i)
    pairs = {(a, b) for ids in shared.values() for a in ids for b in ids if a < b}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in pairs:
        x, y = sets[a], sets[b]
        low = sum(min(x[h], y[h]) for h in x.keys() & y.keys())
        if low / (sum(x.values()) + sum(y.values()) - low) >= 0.8:
            links += 1
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: find(i) for i in sets}, links


def test_classes_are_brute_force(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in table.select("doc_id", "text").collect()]
    idf = neardup.inverse_frequencies(neardup.document_frequencies(table, "text"))
    expected, links = brute_classes(rows, idf)
    got = {x.doc_id: x.class_id for x in neardup.classes(table).collect()}
    assert links > 50 and got == expected


def test_large_group_of_near_copies(spark):
    r = random.Random(4)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(5000)}" for _ in range(n)]
    base = words(300)
    rows = []
    for i in range(120):
        copy = list(base)
        copy[r.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    passage = words(60)
    rows += [(1000 + i, " ".join(words(200) + passage)) for i in range(60)]
    idf = neardup.inverse_frequencies(neardup.document_frequencies(docs(spark, rows), "text"))
    expected, _ = brute_classes(rows, idf)
    got = neardup.classes(docs(spark, rows)).collect()
    assert {x.doc_id: x.class_id for x in got} == expected
    assert {x.class_id for x in got if x.doc_id < 120} == {0} and sum(x.n_links == 0 for x in got) == 60


def test_pairs_in_crowded_groups(spark):
    """Near copies among many unlike documents that share a long passage."""
    r = random.Random(8)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(90000)}" for _ in range(n)]
    passage, rows = words(1500), []
    for i in range(60):
        own = words(60)
        rows += [(i, " ".join(passage + own)), (1000 + r.randrange(100) * 100 + i, " ".join(passage + own[: 60 - 15 - i % 17] + words(15 + i % 17)))]
    idf = neardup.inverse_frequencies(neardup.document_frequencies(docs(spark, rows), "text"))
    expected, links = brute_classes(rows, idf)
    assert 20 <= links < 100
    for pivots in ((1, 8, 8, 8), (1, 2), ()):
        assert {x.doc_id: x.class_id for x in neardup.classes(docs(spark, rows), pivots=pivots).collect()} == expected


def test_every_candidate_is_verified(spark, monkeypatch):
    """A pair at the threshold is verified even if few of its samples agree."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:-12] + [f"x{i}y{k}" for k in range(12)])) for i in range(2)]
    table = docs(spark, rows)
    draw = neardup.Sampler.sample

    def unlucky(self, h, w, sizes):
        out = draw(self, h, w, sizes)
        # a band in common, every other sample apart
        out[:, :2] = np.arange(2)
        out[:, 2:] += np.add.reduceat(h, np.cumsum(sizes) - sizes)[:, None]
        return out

    idf = neardup.inverse_frequencies(neardup.document_frequencies(table, "text"))
    sets = [neardup.packed(*neardup.shingles(neardup.word_hashes(t), idf)) for _, t in rows]
    assert neardup.jaccard(*sets) >= 0.8
    monkeypatch.setattr(neardup, "Sampler", type("Unlucky", (neardup.Sampler,), {"sample": unlucky}))
    assert [x.class_id for x in neardup.classes(table).collect()] == [0, 0]


def test_tied_ids(spark):
    """Texts are searched and classed for themselves, whatever their ids."""
    words = lambda c: [f"{c}{i}" for i in range(100)]
    x, y, z = " ".join(words("x")), " ".join(words("y")), " ".join(words("z"))
    near = lambda t: t + " more"
    rows = [(3, near(x)), (5, x), (5, y), (6, z), (6, near(z)), (9, near(y))]
    found = {(r.doc_id, r.key): r.class_id for r in neardup.classes(docs(spark, rows)).collect()}
    key = lambda t: md5(t.encode()).hexdigest()
    assert found == {(i, key(t)): c for (i, t), c in zip(rows, [3, 3, 5, 6, 6, 5])}
    odd = docs(spark, rows).withColumns({c: F.lit(1) for c in ("__id", "__key", "class_id", "node", "keys")})
    assert neardup.keep_first(odd).columns == odd.columns
    kept = {(r.doc_id, r.text) for r in neardup.keep_first(odd).collect()}
    assert kept in ({(3, near(x)), (5, y), r} for r in rows[3:5])


def test_odd_rows(spark):
    got = neardup.classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {(x.doc_id, x.class_id) for x in got if x.doc_id in (1, 2, 3, 5, 6)} == {(i, i) for i in (1, 2, 3, 5, 6)}
    assert [x.class_id for x in got if x.doc_id == 4] == [4] * 3
    assert neardup.classes(docs(spark, [])).count() == 0
    assert math.isclose(neardup.jaccard(*[neardup.packed(*neardup.shingles(neardup.word_hashes("a b c d e f g " * 3), neardup.inverse_frequencies(neardup.document_frequencies(docs(spark, ODD), "text"))))] * 2), 1)


def test_pipeline(spark):
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    left = {"": frame}
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, SF).persist()
        assert frame.columns == left[""].columns
        left[name] = frame
    texts = {k: {x.doc_id: x.text for x in f.collect()} for k, f in left.items()}
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in texts[""] if labels.get(i) == 0]
    assert sum(i not in texts["toxicity"] for i in clean) <= 0.05 * len(clean)
    classes = {x.doc_id: x.class_id for x in neardup.classes(left["toxicity"]).collect()}
    assert set(texts["near_duplicates"]) == set(classes.values())
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in brute_leaks([(i, t) for i, t in texts["near_duplicates"].items() if len(t) < 4000], items)}
    assert not held & set(texts["decontamination"])
    assert {i for i, t in texts["near_duplicates"].items() if len(t) < 4000} - held <= set(texts["decontamination"])
    times = Counter(x.doc_id for x in left["mixing"].collect())
    assert max(times.values()) <= 3 and set(times) <= set(texts["decontamination"])
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(x.doc_id for x in out) == times
    assert len(queries.QUERIES) == 10


def test_fruitless_rounds_of_pivots_end(spark, monkeypatch):
    """Texts that share a passage but are no near copies go to the exact join after one round of several pivots."""
    r = random.Random(8)
    passage = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(passage + [f"v{r.randrange(10**6)}" for _ in range(60)]) for _ in range(80)]
    texts += [texts[3] + " more", texts[50] + " and more"]
    names, real = [], neardup.staged

    def told(df, name):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(neardup, "staged", told)
    got = {x.doc_id: x.class_id for x in neardup.classes(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: {80: 3, 81: 50}.get(i, i) for i in range(82)}
    assert names.count("judged") == 3


def test_pairs_of_a_large_group_at_the_threshold(spark, monkeypatch):
    """Variants of one text, about as far from each other as the threshold, are classed with a few verified pairs each."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(200):
        copy = list(base)
        for at in r.sample(range(150), r.choice((1, 2, 2))):
            copy[at] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(copy)))
    idf = neardup.inverse_frequencies(neardup.document_frequencies(docs(spark, rows), "text"))
    expected, links = brute_classes(rows, idf)
    counts, real = [], neardup.verified

    def counted(pairs, *args):
        counts.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(neardup, "verified", counted)
    # by the exact join alone
    assert {x.doc_id: x.class_id for x in neardup.classes(docs(spark, rows), pivots=()).collect()} == expected
    assert 0 < sum(counts) < 8 * len(rows) < links
