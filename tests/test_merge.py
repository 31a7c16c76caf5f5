import difflib
import json
import random

import pytest

from keyloom import cli
from keyloom.errors import MergeInputError
from keyloom.operators.merge import Merge, Source
from keyloom.operators import similar
from keyloom.operators.similar import closest
from keyloom.plans import run
from keyloom.plans.plan import MergePlan
from keyloom.sources.grids import read_grid
from keyloom.sources.reader import ROW, Table, TableInfo, read_table

SAMPLES = {
    "recruit.csv": "姓名,手机,应聘岗位\n张三,13800000001,a\n 李四 ,13800000002,b\n王五,13800000003,c\n赵六,,d\n钱七,13800000007,e\n吴十,13800000010,f\n郑十一,13800000011,g\n陈十二,13800000012,h\n",
    "attendance.csv": "员工姓名,部门,工号\n张三,p,EMP-1\n李四,p,EMP-2\n王　五,p,EMP-3\n赵六,p,EMP-6\n孙八,p,EMP-8\n吴十,p,EMP-10\n郑十一,p,EMP-11\n冯十三,p,EMP-13\n",
    "training.csv": "姓名,完成课程,联系方式\n张三,x,13800000001\n李四,x,13800000099\n王五,x,13800000003\n钱七,,13800000007\n吴十,x,13800000010\n郑十一,x,13800000011\n周九,x,1\n褚十四,x,2\n",
}


@pytest.fixture
def files(tmp_path):
    for name, text in SAMPLES.items():
        (tmp_path / name).write_text(text, "utf-8-sig")
    return {n: str(tmp_path / n) for n in SAMPLES}


def plan_of(files, **more):
    keys = ("姓名", "员工姓名", "姓名")
    return {"primary": "recruit.csv", "tables": [{"path": p, "key_col": k} for p, k in zip(files.values(), keys)]} | more


def test_merge_goldens(spark, files, tmp_path):
    out = str(tmp_path / "out.xlsx")
    report = run.merge(spark, MergePlan.of(plan_of(files)), out, save_recipe=str(tmp_path / "r.json"), tables_out=str(tmp_path / "t"))
    assert [report[k] for k in ("n_keys", "n_result_rows", "n_unmatched", "n_conflicts")] == [12, 12, 9, 1]
    assert report["matched_per_file"] == dict.fromkeys(SAMPLES, 8)
    rows, info = read_grid("out.xlsx", open(out, "rb").read())
    assert info["sheet"] == "汇总结果"
    assert rows[0][0] == "关联键" and rows[0][-1] == "数据状态" and rows[0][1] == "手机(来源:recruit.csv)"
    status = {r[0]: r[-1] for r in rows[1:]}
    assert [k for k, s in status.items() if s == "完整匹配"] == ["张三", "王五", "吴十", "郑十一"]
    assert status["李四"] == "冲突:联系方式"
    assert status["周九"] == "部分缺失(缺:recruit.csv、attendance.csv)"
    assert [r[0] for r in rows[1:]] == ["张三", "李四", "王五", "赵六", "钱七", "吴十", "郑十一", "陈十二", "孙八", "冯十三", "周九", "褚十四"]
    again = run.merge(spark, MergePlan.of(plan_of(files)), out, recipe_path=str(tmp_path / "r.json"))
    assert again["n_result_rows"] == 12 and again["recipe"]
    assert json.load(open(str(tmp_path / "out.report.json")))["n_keys"] == 12
    assert spark.read.parquet(str(tmp_path / "t/unmatched")).count() == 9


def test_drop_counts_before_it_drops(spark, files, tmp_path):
    report = run.merge(spark, MergePlan.of(plan_of(files, unmatched_policy="drop")), str(tmp_path / "o.xlsx"))
    assert [report[k] for k in ("n_keys", "n_result_rows", "n_unmatched", "n_conflicts")] == [12, 5, 9, 1]


def test_suggest(spark, files):
    found = run.suggest_keys(spark, run.inspect(spark, list(files.values())))
    top = found["candidates"][0]
    assert (top["a_kind"], top["a_col"]) == ("name", "姓名") and top["score"] >= 0.5
    assert "清洗后" in top["evidence"] and found["recommendation"]["top"]["a_col"] == "姓名"


def test_bad_plans(spark, files, tmp_path):
    for bad in ({}, {"tables": [{"path": "x"}]}, {"tables": [{"path": "x"}, {"path": "y", "key_col": "k"}]}, plan_of(files, unmatched_policy="no")):
        with pytest.raises(MergeInputError):
            MergePlan.of(bad)
    wrong = plan_of(files)
    wrong["tables"][0]["key_col"] = "没有"
    with pytest.raises(MergeInputError, match="不存在键列"):
        run.merge(spark, MergePlan.of(wrong), str(tmp_path / "o.xlsx"))
    (tmp_path / "r.json").write_text('{"tables": [{"file": "别的表.csv", "key_col": "k"}]}')
    with pytest.raises(MergeInputError, match="配方未命中"):
        run.merge(spark, MergePlan.of(plan_of(files)), str(tmp_path / "o.xlsx"), recipe_path=str(tmp_path / "r.json"))


def table(spark, file, headers, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{h}` string" for h in headers) + f", {ROW} long")
    return Table(df, TableInfo(file, headers=headers, n_rows=len(rows), n_cols=len(headers)))


def test_first_rows_blank_keys_and_empty_normal_forms(spark):
    a = table(spark, "a", ["工号", "v"], [("EMP-1", "first"), ("emp1", "second"), ("", "lost"), (None, "lost"), ("EMP-", "blank key")])
    b = table(spark, "b", ["id", "v"], [("1", "x"), ("E", "y")])
    m = Merge([Source(a, "工号"), Source(b, "id")])
    assert [tuple(r) for r in m.result().collect()] == [("1", "first", "x", "冲突：v"), ("", "blank key", "y", "冲突：v")]
    assert m.duplicate_keys(0).collect()[0][:2] == ("1", 2)
    assert m.blank_keys(0).count() == 2
    with pytest.raises(MergeInputError, match="重复"):
        Merge([Source(a, "工号"), Source(a, "工号")])


def test_merge_ignores_partitioning(spark):
    r = random.Random(3)
    rows = [[(f"k{r.randrange(40)}", f"{s}{i}") for i in range(100)] for s in "ab"]
    tables = [table(spark, f, ["姓名", "v"], x) for f, x in zip("ab", rows)]
    plain = Merge([Source(t, "姓名") for t in tables]).result().collect()
    mixed = [Table(t.df.repartition(7, "v"), t.info) for t in tables]
    assert Merge([Source(t, "姓名") for t in mixed]).result().collect() == plain
    native = Merge([Source(t, "姓名") for t in mixed], exact=False).result().collect()
    assert native == plain


def test_one_exchange(spark):
    tables = [table(spark, f, ["姓名", "v"], [("x", "y")]) for f in "abc"]
    plan = Merge([Source(t, "姓名") for t in tables], exact=False).result(ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_closest_is_brute_force(spark):
    r = random.Random(5)
    for _ in range(3):
        keys = list({"".join(r.choice("ab12Cd") for _ in range(r.randrange(1, 9))) for _ in range(40)})
        df = spark.createDataFrame([(k,) for k in keys], "key string")
        got = {x.key: x.closest for x in closest(df, df).collect()}
        for k in keys:
            assert got.get(k, "") == "、".join(difflib.get_close_matches(k, [x for x in keys if x != k], n=3, cutoff=0.5))


def test_closest_at_other_cutoffs(spark):
    r = random.Random(6)
    keys = list({"".join(r.choice("aab é漢1") for _ in range(r.randrange(1, 15))) for _ in range(60)}) + ["a" * 30, "a" * 11]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for cutoff in (0.3, 0.8, 1.0):
        got = {x.key: x.closest for x in closest(df, df, n=2, cutoff=cutoff).collect()}
        for k in keys:
            assert got.get(k, "") == "、".join(difflib.get_close_matches(k, [x for x in keys if x != k], n=2, cutoff=cutoff))


def test_closest_of_numbers_compares_few(spark, monkeypatch):
    """Numbers share most of their digits with most others; only near ones may be compared."""
    keys = [str(i) for i in range(1, 1501)]
    df, compared = spark.createDataFrame([(k,) for k in keys], "key string"), []

    def counted(f):
        def run(*a, **b):
            pairs = f(*a, **b)
            compared.append(pairs.count())
            return pairs

        return run

    for name in ("shared_characters", "by_deletions"):
        if hasattr(similar, name):
            monkeypatch.setattr(similar, name, counted(getattr(similar, name)))
    closest = similar.closest(df, df)
    assert sum(compared) < 100 * len(keys)
    got = {x.key: x.closest for x in closest.collect()}
    for k in [*keys[:20], *keys[95:115], "999", "1000", "1001", "1111", "1222", "1500"]:
        assert got.get(k, "") == "、".join(difflib.get_close_matches(k, [x for x in keys if x != k], n=3, cutoff=0.5))


def test_unmatched_with_candidates_is_brute_force(spark):
    """The registered query's plan, on whole keys of two small sources."""
    a, b = ([f"{x}{i}" for i in range(n)] for x, n in (("张三a", 12), ("张三b", 9)))
    tables = [Table(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"`姓名` string, {ROW} long"), TableInfo(f, headers=["姓名"])) for f, keys in (("x", a + ["z"]), ("y", b + ["z"]))]
    rows = Merge([Source(t, "姓名") for t in tables]).unmatched().collect()
    pool = a + b + ["z"]
    assert [r[2] for r in rows] == a + b
    for r in rows:
        assert r[4] == "、".join(difflib.get_close_matches(r[2], [x for x in pool if x != r[2]], n=3, cutoff=0.5))


def test_cli(spark, files, tmp_path, capsys):
    assert cli.main(["inspect", *files.values(), "--out", str(tmp_path / "p.json"), "--sample", "2"]) == 0
    assert len(json.load(open(tmp_path / "p.json"))["tables"][0]["sample"]) == 2
    assert cli.main(["suggest-keys", "--profile", str(tmp_path / "p.json"), "--out", str(tmp_path / "k.json")]) == 0
    (tmp_path / "plan.json").write_text(json.dumps(plan_of(files)), "utf-8")
    assert cli.main(["merge", "--plan", str(tmp_path / "plan.json"), "--out", str(tmp_path / "o.xlsx")]) == 0
    assert cli.main(["inspect", "--files", *files.values(), "--out", str(tmp_path / "p2.json"), "--backend", "stdlib"]) == 0
    assert [t["n_rows"] for t in json.load(open(tmp_path / "p2.json"))["tables"]] == [8, 8, 8]
    assert cli.main(["inspect", "only-one.csv"]) == 2
    assert cli.main(["selfcheck"]) == 0
    capsys.readouterr()
    assert cli.audit("import subprocess\nfrom urllib import request\neval('1')") == ["subprocess", "urllib", "eval"]


def test_selftest(spark):
    got = cli.selftest(spark)
    assert (got["n_keys"], got["n_keys_cross_format"], got["formats_checked"]) == (7, 2, ["html", "ods", "delimited"])


def test_two_other_formats(spark, tmp_path):
    from .test_sources import ODS, boxed

    html = "<table><tr><th>姓名<th>手机<th>入职日期<tr><td>王五<td>1<td>2024-03-01<tr><td>TRUE<td>2<td>2024-03-05</table>"
    (tmp_path / "old.xls").write_text(html, "utf-8")
    (tmp_path / "t.ods").write_bytes(boxed(**{"content.xml": ODS}))
    (tmp_path / "k.tsv").write_text("姓名\t部门\n王五\tx\nTRUE\ty\n", "utf-8")
    tables = [read_table(spark, str(tmp_path / n)) for n in ("old.xls", "t.ods", "k.tsv")]
    assert [t.info.format for t in tables] == ["html", "ods", "delimited"]
    rows = Merge([Source(t, "姓名") for t in tables]).result().collect()
    assert [r[0] for r in rows] == ["王五", "TRUE"] and all("缺" not in r[-1] for r in rows)
