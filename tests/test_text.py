import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import columns as C
from keyloom.functions import text as T

KEYS = [
    (" 李四 ", "name", "李四"),
    ("王　五", "name", "王五"),
    ("EMP-1001", "id", "1001"),
    ("工号：1002", "id", "1002"),
    ("张三（曾用名张小三）", "name", "张三"),
    ("EMP1001", "id", "1001"),
    ("NO.101", "id", "101"),
    ("EMP--1", "id", "-1"),
    ("EMP-", "id", ""),
    ("EVE", "id", "ve"),
    ("a(b)(c)", "name", "a(b)"),
    ("a()", "name", "a()"),
    ("EMP-7", "auto", "7"),
    ("李 四", "auto", "李四"),
]


@pytest.mark.parametrize("raw,kind,expected", KEYS)
def test_norm_key(raw, kind, expected):
    assert T.norm_key(raw, kind) == expected


def test_native_and_exact_keys_agree(spark):
    for kind in ("id", "name", "auto"):
        rows = [(r, e) for r, k, e in KEYS if k == kind]
        df = spark.createDataFrame(rows, "raw string, expected string")
        got = df.select(C.norm_key(F.col("raw"), kind), C.norm_key_exact(F.col("raw"), kind), "expected").collect()
        assert all(a == b == e for a, b, e in got)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=126), max_size=30))
def test_ascii_rules_are_stable(s):
    assert T.norm_text(T.norm_text(s)) == T.norm_text(s)
    assert not any(c.isspace() for c in T.squeeze(s))


def test_exact_folds_what_native_leaves(spark):
    got = spark.createDataFrame([("Straße ㈱",)], "x string").select(C.norm_key_exact(F.col("x"), "id")).first()[0]
    assert got == "strasse(株)"[: len(got)] or got == "strasse"


def test_headers():
    kinds = {"姓名": "name", "工号": "id", "width": "id", "手机": "contact", "部门": "other", "c_name": "name", "备案号": "id"}
    assert {h: T.header_kind(h) for h in kinds} == kinds
    fields = {"手机号": "联系方式", "联系方式（新）": "联系方式", "所属部门": "部门", "员工姓名": "姓名", "员工编号": "工号", "Amount (x)": "amount"}
    assert {h: T.logical_field(h) for h in fields} == fields
    assert T.name_headers(["a", "", "a", "a"]) == ["a", "列2", "a（2）", "a（3）"]


@pytest.mark.parametrize("raw,expected", [("13800000001.0", "13800000001"), ("1.38E10", "13800000000"), ("1.5", "1.5"), ("x", "x"), (None, ""), ("-2.00", "-2"), ("1e-3", "1e-3")])
def test_number_text(spark, raw, expected):
    assert T.number_text(raw) == expected
    assert spark.createDataFrame([(raw,)], "x string").select(C.number_text(F.col("x"))).first()[0] == expected


def test_aliases(spark):
    assert T.aliases("a、b/ c；|d") == ["a", "b", "c", "d"]
    assert spark.createDataFrame([("a、b/ c；|d",)], "x string").select(C.aliases(F.col("x"))).first()[0] == ["a", "b", "c", "d"]


def test_kernels_are_the_rules(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    pieces = ["EMP-", "no. ", "ID：", "a", "Z9", "ß", "İ", "ﬁ", "（旧）", "(x)", " ", "\t", "\x1c", "\x0b", "\u3000", "\xa0", "\x85", "漢", "Ｅ", "-_", "#", "", "é"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(7))) for _ in range(600)] + [None, ""]
    texts += ["".join(r.choice([p for p in pieces if p.isascii()]) for _ in range(r.randrange(7))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = {"norm_text": (C.norm_text_exact, T.norm_text), "squeeze": (C.squeeze_exact, T.squeeze)}
    rules |= {k: (lambda c, k=k: C.norm_key_exact(c, k), lambda x, k=k: T.norm_key(x, k)) for k in ("id", "name", "auto")}
    rows = df.select("t", *[f(F.col("t")).alias(n) for n, (f, _) in rules.items()]).collect()
    for x in rows:
        assert {n: x[n] for n in rules} == {n: rule(x.t) for n, (_, rule) in rules.items()}, repr(x.t)
