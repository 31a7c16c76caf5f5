"""Suffix arrays, anchors and the whole removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from keyloom.llm import substrings, suffixes
from keyloom.llm.anchors import Buffer
from keyloom.llm.suffixes import common_prefixes, repeated_windows, suffix_array

from .util import ODD, SF, docs


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for _ in range(150):
        s = np.array([r.randrange(r.choice([1, 2, 3, 256])) for _ in range(r.randrange(60))], np.int16)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        p = common_prefixes(s, sa)
        for before, at in zip(sa, sa[1:]):
            k = 0
            while max(before, at) + k < len(s) and s[before + k] == s[at + k]:
                k += 1
            assert p[at] == k


def test_suffix_arrays_of_all_sizes(monkeypatch):
    """Keys of three ranks and a place, of three ranks and of two give one order, and few sorts find long repeats."""
    r = random.Random(5)
    text = bytes(r.randrange(97, 123) for _ in range(440))
    long = np.array([c + 1 for i in range(3) for c in (*text[i:], -1)], np.int16)
    sorts, real = [], suffixes.in_order
    monkeypatch.setattr(suffixes, "in_order", lambda *args: sorts.append(args[2]) or real(*args))
    for place_bits, rank_bits, most in ((16, 21, 5), (0, 21, 5), (0, 2, 8)):
        monkeypatch.setattr(suffixes, "PLACE_BITS", place_bits)
        monkeypatch.setattr(suffixes, "RANK_BITS", rank_bits)
        sorts.clear()
        assert suffix_array(long).tolist() == sorted(range(len(long)), key=lambda i: long[i:].tolist())
        assert 3 < len(sorts) <= most and set(sorts) == {place_bits > 0}
        for _ in range(50):
            s = np.array([r.randrange(r.choice([1, 3, 511])) for _ in range(r.randrange(60))], np.int16)
            assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_copies_part_where_they_end(monkeypatch):
    """Ends are unlike each other, the earlier first, so no order and no prefix goes past one, and copies in a row need no more sorts than one."""
    r = random.Random(7)
    sorts, real = [], suffixes.in_order
    monkeypatch.setattr(suffixes, "in_order", lambda *args: sorts.append(args[2]) or real(*args))
    text = [r.randrange(1, 4) for _ in range(300)]
    cases = [[text] * 12] + [[[r.randrange(1, 3) for _ in range(r.randrange(9))] for _ in range(r.randrange(1, 9))] for _ in range(150)]
    for place_bits in (16, 0):
        monkeypatch.setattr(suffixes, "PLACE_BITS", place_bits)
        for texts in cases:
            s = np.array([c for t in texts for c in (*t, 0)], np.int16)
            ends = np.flatnonzero(s == 0)
            apart = [c or i - len(s) for i, c in enumerate(s.tolist())]
            sorts.clear()
            sa = suffix_array(s, ends)
            assert texts is not cases[0] or len(sorts) <= 5
            assert sa.tolist() == sorted(range(len(s)), key=lambda i: apart[i:])
            p = common_prefixes(s, sa, ends)
            for before, at in zip(sa, sa[1:]):
                k = 0
                while max(before, at) + k < len(s) and apart[before + k] == apart[at + k]:
                    k += 1
                assert p[at] == k


def test_repeated_windows():
    r = random.Random(3)
    for _ in range(150):
        texts = [bytes(r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(40))) for _ in range(r.randrange(6))]
        n = r.randrange(1, 8)
        count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        every = [len(t) for t in texts]
        assert [x.tolist() for x in repeated_windows(texts, every, n)[0]] == [[count[t[i : i + n]] > 1 for i in range(len(t) - n + 1)] for t in texts]
        assert [x.tolist() for x in repeated_windows(texts, every, 3, n)[1]] == [x.tolist() for x in repeated_windows(texts, every, n)[0]]
        some = [r.randrange(len(t) + 1) for t in texts]
        count = Counter(t[i : i + n] for t, w in zip(texts, some) for i in range(min(w, len(t) - n + 1)))
        assert [x.tolist() for x in repeated_windows(texts, some, n)[0]] == [[count[t[i : i + n]] > 1 for i in range(min(w, len(t) - n + 1))] for t, w in zip(texts, some)]


def test_runs_cover_all_windows_alike():
    r = random.Random(4)
    shared = bytes(r.randrange(97, 123) for _ in range(900))
    texts = [bytes(r.randrange(97, 123) for _ in range(300)) + shared, shared + b"x" * 50, b"short", b"a" * 1000]
    b = Buffer(texts)
    text, first, last, anchor = b.runs(400, 300, 10**6)
    for i, t in enumerate(texts):
        own = text == i
        covered = [w for f, z in zip(first[own], last[own]) for w in range(f, z + 1)]
        assert covered == [b.starts[i] + w for w in range(len(t) - 399)]
    place = lambda i, w: next(a - (b.starts[i] + w) for t, f, z, a in zip(text, first, last, anchor) if t == i and f <= b.starts[i] + w <= z)
    assert [place(0, 300 + w) for w in range(501)] == [place(1, w) for w in range(501)]
    h = b.hashes(np.array([300]), np.array([700]), 0), b.hashes(b.starts[1:2], b.starts[1:2] + 400, 0)
    assert h[0] == h[1]


def test_arrays_get_what_may_repeat(monkeypatch):
    """Contexts that share no more than their anchor stay out of the arrays, and nothing that is repeated does."""
    r = random.Random(8)
    prose = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    lines, passage = [prose(220) for _ in range(12)], prose(1200)
    texts = [prose(500) + line + prose(500) for line in lines * 8] + [prose(300) + passage[i * 100 : 700 + i * 100] + prose(300) for i in range(4)] + [prose(300) + passage] * 2
    rows = []
    buffer = Buffer(texts)
    for text, first, last, anchor in zip(*(x.tolist() for x in buffer.runs(280, 200, 10**6))):
        at = first - int(buffer.starts[text])
        h = hash(bytes(buffer.data[anchor : anchor + 80]))
        rows.append({"h": h, "c": len(rows), "place": 0, "salt": -1, "windows": last - first + 1, "data": texts[text][at : at + last - first + 400]})
    rows.sort(key=lambda x: x["h"])
    given, real = [], substrings.repeated_flags
    monkeypatch.setattr(substrings, "repeated_flags", lambda t, *a: given.append(sum(map(len, t))) or real(t, *a))
    shared = {h for h, n in Counter(x["h"] for x in rows).items() if n > 1}
    every = sum(len(x["data"]) for x in rows if x["h"] in shared)
    for most in (1 << 18, 2000):
        monkeypatch.setattr(substrings, "HELD_BYTES", most, raising=False)
        given.clear()
        got = [x for b in substrings.shard_windows(iter([pa.RecordBatch.from_pylist(rows, substrings.CUT)]), (400, 280)) for x in b.to_pylist()]
        assert 0 < sum(given) < 0.6 * every
        for length, flags in zip((400, 280), repeated_windows([x["data"] for x in rows], [x["windows"] for x in rows], 400, 280)):
            expected = {(x["h"], x["c"], int(i)) for x, f in zip(rows, flags) for i in np.flatnonzero(f)}
            assert {(x["h"], x["c"], i) for x in got if x["size"] == length for i in range(x["lo"], x["hi"])} == expected != set()


def test_spans_of_many_rows():
    r = random.Random(9)
    sizes = np.array([r.randrange(30) for _ in range(300)])
    runs = [None if r.random() < 0.2 else [{"lo": (lo := r.randrange(40)), "hi": lo + r.randrange(1, 5)} for _ in range(r.randrange(5))] for _ in sizes]
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for lo, hi in ((0, 300), (37, 40), (0, 0)):
        row, a, b = substrings.spans(pa.array(runs, kind)[lo:hi], 6, sizes[lo:hi])
        got = [[] for _ in range(lo, hi)]
        for i, x, y in zip(row.tolist(), a.tolist(), b.tolist()):
            got[i].append((x, y))
        for n, own, spans in zip(sizes[lo:hi].tolist(), runs[lo:hi], got):
            gone = {w + k for x in own or () for w in range(x["lo"], x["hi"]) if w + 6 <= n for k in range(6)}
            assert spans == [(s, next(e for e in range(s, n + 1) if e not in gone)) for s in sorted(gone) if s - 1 not in gone]


def brute(texts, n, passage=280):
    if passage:
        return [(*x, y[1]) for x, y in zip(brute(texts, n, 0), brute(texts, passage, 0))]
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, m in zip(d, mask) if not m)
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(d), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_dedup_is_brute_force(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdé漢") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(200)
    rows = [x[:2] for x in ODD if not x[1] or len(x[1]) < 5000]
    rows += [(20 + i, prose(r.randrange(30)) + passage + prose(r.randrange(30))) for i in range(8)]
    rows += [(40, "x" * 1500), (41, prose(300)), (42, passage[:450] + prose(5) + passage[100:600]), (43, passage), (43, passage), (44, (p := prose(120)) + " " + p)]
    rows += [(50 + i, passage[i : i + 420]) for i in range(0, 60, 7)]
    rows += [(90 + i, prose(20) + passage[40 + i : 340] + prose(20)) for i in range(0, 30, 9)]
    expected = sorted(map(repr, zip([r[0] for r in rows], brute([r[1] for r in rows], 400))))
    frame = docs(spark, rows).repartition(5)
    for most in (substrings.SHARD_CONTEXTS, 2, 5000):
        monkeypatch.setattr(substrings, "SHARD_CONTEXTS", most)
        got = [(x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.n_passage_bytes)) for x in substrings.dedup(frame).collect()]
        assert sorted(map(repr, got)) == expected
    kept = {x.doc_id: bytes(x.kept) for x in substrings.dedup(frame, with_data=True).collect()}
    assert kept[41] == next(t for i, t in rows if i == 41).encode() and kept[43] == b""
    assert substrings.dedup(docs(spark, [])).count() == 0


def test_long_texts_in_pieces(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.n_passage_bytes) for x in substrings.dedup(docs(spark, rows), text_bytes=700).collect()}
    assert got == dict(zip([r[0] for r in rows], brute([r[1] for r in rows], 400)))


def test_most_windows_are_settled_by_the_arrays(spark, monkeypatch):
    """Of the repeated windows of sf0.01, apart from those of equal texts; and the merge across shards runs."""
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").dropDuplicates(["text"])
    seen = {}

    def keep(df, name):
        seen[name] = staged(df, name)
        return seen[name]

    staged = substrings.staged
    monkeypatch.setattr(substrings, "staged", keep)
    monkeypatch.setattr(substrings, "discard", lambda *frames: None)
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", 20)
    substrings.repeated_runs(table)
    kinds, windows, runs = seen["kinds"], seen["windows"], seen["runs"]
    assert kinds.where("n > 1 AND q IS NULL").count() == 0
    by_arrays = windows.where("d1 IS NULL").selectExpr("sum(hi - lo)").first()[0]
    every = runs.distinct().selectExpr("sum(hi - lo)").first()[0]
    assert by_arrays > 0.9 * every > 0
    assert windows.where("d1 IS NOT NULL").count() > 0
