"""Tokens, quality rules, WARC, main text, mixing and toxicity."""

import gzip
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import htmltext, mixing, quality, queries, tokens, toxicity, warc
from keyloom.llm.common import new_dir

from .util import ODD, SF, docs


def test_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    r = random.Random(1)
    odd = ["".join(r.choice(["a", "b'", "'s", " ", "  ", "\n", "\t", "é", "9", ".", "漢", "　", "\x1c", "\x00", "<|endoftext|>", "​"]) for _ in range(40)) for _ in range(200)]
    rows = ODD + [(100 + i, t) for i, t in enumerate(odd)]
    got = tokens.token_table(docs(spark, rows).repartition(6), queries.tokenizer_path()).collect()
    assert len(got) == len(rows)
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(whole.encode(x[1] or "", add_special_tokens=False).ids + [0])
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        ids = next(i for i in by[x.doc_id] if len(i) == x.n_tokens and zlib.crc32(np.array(i, "<u4").tobytes()) == x.ids_crc32)
        by[x.doc_id].remove(ids)
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id if x.doc_id is not None else -1 for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order)


def test_token_files(spark):
    import pyarrow.parquet as pq

    path = new_dir(spark, "t")
    tokens.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path, queries.tokenizer_path())
    file = next(Path(path.removeprefix("file://")).glob("part-*"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    codings = {group.column(i).path_in_schema.split(".")[0]: group.column(i).encodings for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in codings["id"] and any("DICTIONARY" in e for e in codings["tokens"])
    assert group.column(0).has_column_index and group.column(0).has_offset_index
    assert tokens.token_table(docs(spark, []), queries.tokenizer_path()).count() == 0
    every = tokens.read_range(spark, path).collect()
    some = tokens.read_range(spark, path, 50, 69)
    assert {x.id: x.tokens for x in some.collect()} == {x.id: x.tokens for x in every if 50 <= x.id <= 69}
    assert all(x.n_tokens == len(x.tokens) for x in every)
    plan = tokens.read_range(spark, path, 50, 69, ("id", "n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50)" in plan and "ReadSchema: struct<id:bigint,n_tokens:bigint>" in plan


def brute_quality(text):
    data = (text or "").encode()
    words = data.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in data.split(b"\n") if x.split()]
    return len(words), len((text or "")) - sum(c in " \t\n\r\x0b\x0c" for c in text or ""), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    line = "This very line stands in many documents of one host, every time the same."
    unique = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = ODD + [(100 + i, f"{line.upper() if i % 2 else line}\n{unique(i)}", "h") for i in range(15)] + [(200 + i, f"{line}\n\n{line}\na{i}", "h") for i in range(3)]
    rows += [(300 + i, line + "\nthe same copy", "g") for i in range(30)] + [(400, "a b c d e f g h i j a b c d e #*$", "g"), (401, "x y\nx y\n \nz", "g")]
    got = quality.quality(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(brute_quality(r[1]))
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) in texts[x.doc_id]
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept)
    by = {x.doc_id: x for x in got}
    assert sum(by[100 + i].n_removed_lines for i in range(15)) + sum(by[200 + i].n_removed_lines > 0 for i in range(3)) == 17
    assert all(by[100 + i].kept for i in range(15))  # thirty words of their own are left
    assert sum(by[200 + i].kept or by[200 + i].base_failed for i in range(3)) >= 0 and not any(by[200 + i].kept and by[200 + i].n_removed_lines for i in range(3))
    assert all(by[300 + i].n_removed_lines == 0 for i in range(30))  # copies are one text
    assert quality.quality(docs(spark, [])).count() == 0
    frame = docs(spark, rows).withColumns({c: F.lit(1) for c in ("__host", "__key", "__own", "line", "lines")})
    stripped = quality.strip_lines(frame)
    assert stripped.columns == frame.columns and stripped.count() == len(rows)
    left = {(x.doc_id, x.text) for x in stripped.collect()}
    assert sum((100 + i, unique(i)) in left for i in range(15)) + sum((200 + i, f"\na{i}") in left for i in range(3)) == 17
    assert {(r[0], r[1]) for r in rows if r[0] is None or r[0] < 100 or r[0] >= 300} <= left
    assert quality.strip_lines(docs(spark, [])).count() == 0
    by_id = {x.doc_id: x for x in quality.quality(docs(spark, rows), distinct="ids").collect()}
    assert by_id[301].n_removed_lines == 0 and by_id[401].n_removed_lines == 0
    other = docs(spark, rows + [(500 + i, line + f"\n{unique(i)}", "g") for i in range(2)])
    assert [sum(x.n_removed_lines > 0 for x in quality.quality(other, distinct=d).collect() if (x.doc_id or 0) >= 500) for d in ("texts", "ids")] == [0, 2]


def test_warc_round_trip(spark):
    html = "<p>" + "x" * 200
    rows = [(3, "http://a", html), (1, "http://b\r\nX: y", html), (2, None, html), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 60), (9, "u", "é" * 60), (9, "u", "é" * 60), (None, "n", "z" * 150), (10, "u", "z" * 150), (11, "big", "y" * 300000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, shard int, digest string").repartition(3)
    out = new_dir(spark, "warc")
    manifest = warc.write_warc(pages, out, shard_bytes=400, roll_bytes=300)
    got = warc.read_warc(manifest, out).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    seen = Counter()
    for x in sorted(got, key=lambda x: (x.page_id or 99, x.record_type == "revisit")):
        h = next(h for i, _, h in rows if i == x.page_id)
        payload = (h or "").encode()
        assert (x.payload_bytes, x.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        again = h in first and (x.page_id != first[h] or seen[h] > 0)
        assert (x.record_type, x.refers_to) == (("revisit", first[h]) if again else ("response", None)), x
        seen[h] += 1
    folder = Path(out.removeprefix("file://"))
    assert not (folder / "_temporary-warc").exists()
    listed = manifest.collect()
    for f in listed:
        data = (folder / f.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f.sha256 and len(data) == f.bytes
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == f.records
    again = warc.write_warc(pages.repartition(5), new_dir(spark, "warc"), shard_bytes=400, roll_bytes=300).collect()
    assert sorted(again) == sorted(listed)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    heads = {h["x-page-id"] + h["warc-type"]: h for f in listed for h, _ in warc.parse((folder / f.file).open("rb"))}
    assert heads["3revisit"]["warc-refers-to"] == heads["1response"]["warc-record-id"] and heads["3revisit"]["warc-refers-to-target-uri"] == heads["1response"]["warc-target-uri"] == "http://b X: y"


def test_warc_shards(spark):
    """Outlying ids and gaps don't decide on a shard's size."""
    ids = [-(10**18), *range(500), 10**12, 10**18]
    rows = spark.createDataFrame([(i, 400) for i in ids] + [(None, 1)], "id long, n_bytes long")
    bounds = warc.shard_bounds(rows, 20_000)
    held = Counter(sum(b <= i for b in bounds) for i in ids)
    assert bounds == sorted(bounds) and 25 <= len(bounds) <= 60 and max(held.values()) <= 20
    assert warc.shard_bounds(rows.repartition(7), 20_000) == bounds
    assert warc.shard_bounds(rows.limit(0), 20_000) == [] and warc.shard_bounds(rows.where("id = 3"), 100) == []


PAGES = [
    (None, ""),
    ("", ""),
    ("just  text\nhere", "just text here"),
    ("<nav>menu</nav><article><h1>Title</h1><p>One &amp; two,\n three.<p>Four, <b>five</b>&nbsp;six.</article><footer>end</footer>", "Title\nOne & two, three.\nFour, five six."),
    ('<div id="menu"><a href=x>m</a></div><div class="post"><h2>T</h2><p>Hello, world; more text here, okay.<p>Second, para; yes.</div><div class=comments><p>Nice one!</div>', "T\nHello, world; more text here, okay.\nSecond, para; yes."),
    ("<main><p>Real text, long enough.<script>var a='<p>no</p>'</script><style>p{}</style></p><form><p>Sign up</p></form><aside>side</aside></main>", "Real text, long enough."),
    ("<article><p>Cut off, in the mid", "Cut off, in the mid"),
    ('<div class="post"><div class="post-header"><h1>Title</h1></div><p>Real text, long enough; with x<sup>2</sup> and <math><mi>y</mi><mo>=</mo><mn>2</mn></math>.</p></div>', "Title\nReal text, long enough; with x2 and y=2."),
    ("<!-- <p>no</p> --><body><p>a &lt; b, &#233;t&eacute; &unknown; end.</p></body>", "a < b, été &unknown; end."),
]


def test_main_text(spark):
    for page, text in PAGES:
        assert htmltext.main_text(page) == text
    frame = spark.createDataFrame([(i, None, p, "t", 1) for i, (p, _) in enumerate(PAGES)] + [(0, None, None, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = htmltext.extract(frame).collect()
    assert {x.page_id: (x.text, x.n_chars) for x in got} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} and len(got) == len(PAGES) + 1
    assert htmltext.extract(frame.limit(0)).count() == 0


def test_main_text_of_several_elements():
    text = lambda c, n: [f"{c}{i} goes on with words, and more words; it ends here." for i in range(n)]
    p = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    a, b = text("a", 20), text("b", 18)
    for tag in ("article", "main", "div", "section"):
        for x, y in ((a, b), (a, b[:7]), (b[:7], a)):
            page = f"<html><body><nav><a href='/'>Home</a></nav><{tag}>{p(x)}</{tag}><{tag}>{p(y)}</{tag}><footer>Imprint</footer></body></html>"
            assert htmltext.main_text(page) == "\n".join(x + y)


def unnamed_page(n=12):
    """A page whose elements have no telling names."""
    text = [f"Paragraph {i} goes on with words, and more words; it says so, and it ends here." for i in range(n)]
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9))
    items = ["one item", "another item"]
    p = "".join(f"<p>{x}</p>" for x in text[: n // 2]) + f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><h2>Part</h2>" + "".join(f"<p>{x}</p>" for x in text[n // 2 :])
    page = f"<html><body><div><ul>{links}</ul></div><div><h1>Title</h1><span>Today 5 min</span><div>{p}</div><div>Reprint 2020</div><h3>More</h3><ul>{links}</ul></div><div>Imprint</div></body></html>"
    return page, ["Title", *text[: n // 2], *items, "Part", *text[n // 2 :]]


def test_path_ratios_decide(monkeypatch):
    page, expected = unnamed_page()
    assert htmltext.main_text(page) == "\n".join(expected)
    for paths in (lambda blocks, share: set(), lambda blocks, share: {b.path for b in blocks}):
        monkeypatch.setattr(htmltext, "content_paths", paths)
        assert htmltext.main_text(page) != "\n".join(expected)


def test_main_text_is_brute_force(spark):
    """The pages' articles by a parser that knows their three tags."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks += [""] * (tag in ("p", "h1"))
            self.blocks[-1] += " " * (tag == "br")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks += [""] * (tag in ("p", "h1"))

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    for x in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect():
        found = Article()
        found.feed(x.html or "")
        found.close()
        assert htmltext.main_text(x.html) == "\n".join(t for b in found.blocks if (t := " ".join(b.split())))


def test_main_text_of_pages(spark):
    import re

    for x in spark.read.parquet(f"{SF}/pages.parquet").collect():
        got = htmltext.main_text(x.html)
        footer = re.search(r"<footer>(.*?)(?:</footer>|$)", x.html, re.S)[1][-30:]
        assert footer not in got and "track(" not in got and "<" not in got


def brute_levels(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
        free -= over
    return out


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), r.choice(["a", "b", "c", "c", "c", "c", "d", None])) for i in range(600)] + [(1000, "w " * 50, "tiny"), (1001, None, "nothing"), (1001, None, "nothing"), (None, "a b", "a"), (5, "w w", "a"), (5, "w w", "a")]
    got = mixing.plan_mix(docs(spark, [(i, t, s) for i, t, s in rows]).repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    levels = brute_levels(sizes)
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(levels[x.source])
        assert x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
    for s in sizes:
        assert abs(taken[s] - levels[s]) <= 50
    again = mixing.plan_mix(docs(spark, [(i, t, s) for i, t, s in rows]).repartition(2)).collect()
    assert sorted(again, key=repr) == sorted(got, key=repr)
    frame = docs(spark, [(i, t, s) for i, t, s in rows])
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(x.copies for x in got)
    assert mixing.plan_mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n, other", [(40, 30), (40, 5), (7, 90), (3, 0)])
def test_mixing_repeated_rows(spark, n, other):
    """Equal rows come out as often as the plan says, beside columns with inner names."""
    rows = [(1, "w " * 5, "a")] * n + [(10 + i, "w " * 7, "b") for i in range(other)]
    frame = docs(spark, rows).repartition(3)
    plan = mixing.plan_mix(frame).collect()
    odd = frame.withColumns({c: F.lit(c) for c in ("__id", "__key", "__copies", "__source", "order_key", "tie", "row", "cut", "s")})
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    got = Counter(x.doc_id for x in mixed.collect())
    assert got[1] == sum(x.copies for x in plan if x.doc_id == 1) and sum(got.values()) == sum(x.copies for x in plan)
    words = sum(x.copies * x.size for x in plan if x.doc_id == 1)
    assert abs(words - plan[0].target) <= 5 if not other else words <= 3 * 5 * n


def test_mixing_levels_in_tables(spark, monkeypatch):
    r = random.Random(9)
    sizes = [(f"s{i:02d}", r.choice([0, 1, 10, 100, 5000]), i % 3 + 1) for i in range(30)]
    for table in (sizes, [("a", 3, 1)], [("a", 0, 1)], sizes[:0]):
        frame = spark.createDataFrame(table, "source string, source_size long, weight long")
        monkeypatch.setattr(mixing, "DRIVER_SOURCES", 100)
        few = sorted(mixing.water_levels(frame).collect())
        monkeypatch.setattr(mixing, "DRIVER_SOURCES", -1)
        assert sorted(mixing.water_levels(frame).collect()) == few if table else not few


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(table, labels.where("doc_id % 2 = 0"))
    got = {x.doc_id: x for x in toxicity.grade(table, model).collect()}
    test = [(x.toxic, got[x.doc_id].rejected) for x in labels.where("doc_id % 2 = 1").collect()]
    caught = sum(t == 1 and r for t, r in test) / sum(t == 1 for t, _ in test)
    wrong = sum(t == 0 and r for t, r in test) / sum(t == 0 for t, _ in test)
    assert caught > 0.75 and wrong < 0.01
    assert all(model.thetas[1:] >= model.thetas[:-1])
    worst = [x.expected_severity for x in got.values() if x.grade >= 2]
    assert min(worst) > np.mean([x.expected_severity for x in got.values()])


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, ODD), labels)
    got = toxicity.grade(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and not any(x.rejected for x in got)
    kept = toxicity.drop_toxic(docs(spark, ODD), model)
    assert kept.count() == len(ODD) and kept.columns == docs(spark, ODD).columns
    assert toxicity.grade(docs(spark, []), toxicity.fit(docs(spark, []), labels.limit(0))).count() == 0


def test_labels_of_one_kind_and_repeated_ids(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(i, words("bad" if i % 2 else "good", 12) + f" own{i}", "s") for i in range(600)] + [(1, "zzz " * 9, "s")] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.grade(docs(spark, rows), toxicity.fit(docs(spark, rows), labels)).collect()
    assert {x.rejected for x in got if x.doc_id % 2 and x.doc_id != 1} == {True} and not any(x.rejected for x in got if x.doc_id % 2 == 0)
    for one in ("toxic = 0", "toxic = 1"):
        model = toxicity.fit(docs(spark, rows), labels.where(one))
        assert not any(x.rejected for x in toxicity.grade(docs(spark, rows), model).collect())


def test_ordinal_fit_is_brute_force():
    """The optimum of the same loss by plain gradient steps on dense numbers."""
    r = np.random.default_rng(3)
    x = (r.random((80, 6)) < 0.4).astype(float)
    score = x @ np.array([2.0, -1.5, 1.0, 0, 0, 0.5]) + r.logistic(size=80)
    target = (score[:, None] > np.array([-0.5, 0.8, 2.0])[None, :]).astype(float)
    row, column = (v.astype(np.int32) for v in np.nonzero(x))
    w, thetas = toxicity.descend(row, column, 80, 6, target, 0.0, 0.01, 3000)
    v, cuts = np.zeros(6), np.array([-1.0, 0.0, 1.0])
    for _ in range(40_000):
        error = 1 / (1 + np.exp(cuts[None, :] - (x @ v)[:, None])) - target
        v -= 0.2 * (x.T @ error.sum(1) / 80 + 0.01 * v)
        cuts += 0.2 * error.mean(0)
    assert np.allclose(w, v, atol=1e-3) and np.allclose(thetas, cuts, atol=1e-3)


def test_ordinal_thresholds_share_weights():
    r = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        g = int(r.integers(0, 4))
        rows.append(np.unique(np.concatenate([r.integers(100, 400, 20), np.arange(g * 3)])))
        grades.append(g)
    model = toxicity.fit_ordinal(rows, np.array(grades))
    assert set(model.features.tolist()) <= set(range(9)) | set(range(100, 400))
    table = dict(zip(model.features.tolist(), model.weights.tolist()))
    score = np.array([sum(table.get(int(f), 0) for f in x) for x in rows])
    predicted = (model.above(score) > 0.5).sum(1)
    assert (predicted == np.array(grades)).mean() > 0.9



def test_ordinal_fit_takes_little_memory():
    """Beside the rows, the fit holds the entries of features that may be picked, not copies of all."""
    r = np.random.default_rng(4)
    grades = (r.random(2000) < 0.1).astype(int)
    rows = [np.unique(np.append(r.integers(0, 5000, 250), 6000 + r.integers(0, 9, 5) * g)).astype(np.int32) for g in grades]
    tracemalloc.start()
    model = toxicity.fit_ordinal(rows, grades)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.features) and most < 8 * sum(map(len, rows))
