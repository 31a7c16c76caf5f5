"""License scan and decontamination against brute force."""

import re
from itertools import combinations

from pyspark.sql import functions as F

from keyloom.llm import decontaminate, licenses

from .util import ODD, SF, docs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(text):
    w = words(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    labels, score = {x[1] for x in places}, 0.0
    base = set(labels)
    for t in licenses.template_rows(licenses.TEMPLATES, 0.8):
        for i in range(len(w)):
            met = t.words & set(w[i : i + t.width])
            if len(met) >= 0.8 * len(t.words) and len(met & t.telling) >= 0.8 * len(t.telling):
                labels.add(t.label)
                score = max(score, len(met) / len(t.words))
    first, last = (places[0][0], places[-1][0]) if places else (None, None)
    return len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


PLANTED = [
    (20, "CC BY cc by, Cc-By! all rights reserved"),
    (21, "Some words.\nLicensed under CC BY-NC 4.0.\nMore text"),
    (22, "Released under a MIT License. All Rights reserved all rights reserved"),
    (23, "the general public license general public license"),
    (24, "Permission is hereby granted, free of charge, to any person who gets a copy of this software and associated documentation files"),
    (25, "licensed the under apache"),
    (26, "ALLİ rights reserved acc by cc byx"),
    (27, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\n// software and associated documentation files (the Software)"),
    (28, "Licensed under the Apache License,\n# Version 2.0 (the License)"),
    (29, "This work is licensed under the GNU General Public License, version 3."),
    (30, "under a long line of words that the mit has of its own and that goes on and on until it is licensed by some other license"),
]
LABELS = {21: "cc-by,cc-by-nc", 22: "mit,reserved", 24: "mit", 27: "mit", 28: "apache", 29: "gpl", 30: ""}


def test_scan_is_brute_force(spark):
    rows = ODD + PLANTED
    got = licenses.scan(docs(spark, rows)).collect()
    expected = sorted([(r[0] or -1, *brute_scan(r[1])) for r in rows], key=repr)
    assert {r.doc_id: r.labels for r in got if r.doc_id in LABELS} == LABELS
    assert sorted([(r[0] or -1, *r[1:7], round(r[7], 9)) for r in got], key=repr) == expected


def test_scan_on_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {r.doc_id: brute_scan(r.text) for r in table.select("doc_id", "text").collect()}
    assert {r[0]: (*r[1:7], round(r[7], 9)) for r in licenses.scan(table).collect()} == expected


def test_scan_of_nothing(spark):
    empty = docs(spark, [])
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs(spark, PLANTED), templates={}).count() == len(PLANTED)
    assert licenses.scan(docs(spark, PLANTED), phrases={}).count() == len(PLANTED)


def test_notices(spark):
    got = {(r.doc_id, r.label): r for r in licenses.notices(docs(spark, PLANTED)).collect()}
    assert set(got) == {(21, "cc-by-nc"), (22, "mit"), (24, "mit"), (27, "mit"), (28, "apache"), (29, "gpl")}
    assert (got[28, "apache"].start, got[28, "apache"].block, got[28, "apache"].score) == (0, "licensed under the apache license version 2 0 the license", 1.0)


def test_no_shared_words_make_a_license(spark):
    """On the tables, a label comes only with its own name."""
    names = {"apache": "apache", "mit": "mit", "gpl": "general public", "cc-by-nc": "nc", "cc-by-sa": "sa", "mpl": "mozilla"}
    found = licenses.scan(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).where("labels <> base_labels").select("doc_id", "labels")
    rows = found.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), "doc_id").collect()
    assert len(rows) > 20
    for r in rows:
        text = " " + " ".join(words(r.text)) + " "
        assert all(f" {names[x]} " in text for x in r.labels.split(",") if x in names), (r.doc_id, r.labels)


def test_native(spark):
    frame = licenses.scan(docs(spark, PLANTED))
    assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())


def brute_leaks(texts, items, threshold=0.8):
    """All alignments of all pairs."""
    out = {}
    for i, t in texts:
        w = words(t)
        for j, x in items:
            v = words(x)
            if not v or not w:
                continue
            best = max(sum(0 <= s + k < len(w) and w[s + k] == v[k] for k in range(len(v))) for s in range(-len(v) + 1, len(w)))
            if best >= threshold * len(v):
                out[i, j] = best
    return out


def test_leaks_are_brute_force(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spoiled = bench[3][1].split()
    for k in (4, 13, 17):
        spoiled[k] = "other"
    texts = [*ODD, (30, "a b c " + bench[0][1] + " d e"), (31, " ".join(spoiled)), (32, bench[5][1] + " " + bench[6][1]), (33, " ".join(bench[7][1].split()[: len(bench[7][1].split()) // 2])), (34, bench[8][1]), (34, bench[8][1])]
    texts += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 900").limit(60).collect()]
    items = bench[:20] + [(None, None), (None, ""), (77, "too short"), bench[0]]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("doc_id", F.lit(1))
    expected = brute_leaks([t[:2] for t in texts if t[0] != 6], [x for x in items if x[1]])
    for bound, piece in ((decontaminate.MAX_BROADCAST, decontaminate.PIECE), (decontaminate.MAX_BROADCAST, 20), (0, decontaminate.PIECE)):
        got = decontaminate.report(docs(spark, texts), benchmark, max_broadcast=bound, piece_words=piece)
        assert {(r.doc_id, r.item_id): r.n_matched for r in got.collect()} == expected
        assert got.count() == len(expected)
        assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    kept = decontaminate.drop_leaks(docs(spark, texts).withColumn("__id", F.lit(1)).withColumn("__KEY", F.lit("k")), benchmark).drop("__id", "__KEY")
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(t[0] or -1 for t in texts if t[0] not in {k[0] for k in expected})
    assert decontaminate.report(docs(spark, []), benchmark).count() == 0
    assert decontaminate.report(docs(spark, texts), benchmark.limit(0)).count() == 0


def test_masks_survive_what_they_say():
    for mask in ("11011", "1101011", "111"):
        for n in range(1, 15):
            for k in range(n + 1):
                whole = all(any(all(p + i not in lost for i, x in enumerate(mask) if x == "1") for p in range(n - len(mask) + 1)) for lost in combinations(range(n), k))
                assert decontaminate.survives(mask, n, k) == whole
    assert all(decontaminate.survives("11011", n, n // 5) for n in (*range(12, 120), 1000, 100_000))


def test_every_substitution_is_found(spark):
    """All patterns at the threshold, of items from one word on."""
    texts, items, expected = [], [], set()
    for n in (1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 15):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(n // 5 + 2):
            for lost in combinations(range(n), k):
                texts.append((len(texts), "before " + " ".join("other" if i in lost else w for i, w in enumerate(item)) + " after"))
                if n - k >= 0.8 * n:
                    expected.add((texts[-1][0], n))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontaminate.MAX_BROADCAST, 0):
        got = decontaminate.report(docs(spark, texts), benchmark, max_broadcast=bound).collect()
        assert len(got) == len(expected) and {(r.doc_id, r.item_id) for r in got} == expected
