"""Command line: inspect, suggest-keys, merge, selfcheck, selftest."""

from __future__ import annotations

import argparse
import ast
import io
import json
import sys
import tempfile
import zipfile
from pathlib import Path

from .errors import MergeInputError
from .lexicon import KEY, STATUS
from .plans import run
from .plans.plan import MergePlan, dump_json, load_json
from .sources.reader import read_table

#: Calls and modules that code which only reads and writes tables has no use for.
DANGEROUS_CALLS = {"eval", "exec", "os.system", "os.popen"}
DANGEROUS_MODULES = {"subprocess", "socket", "urllib", "http", "requests", "ftplib", "smtplib"}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("keyloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def audit(source: str) -> list[str]:
    """Dangerous imports and calls in one module."""
    found = []
    for node in ast.walk(ast.parse(source)):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) and not node.level else []
        found += [n for n in names if n.split(".")[0] in DANGEROUS_MODULES]
        if isinstance(node, ast.Call) and ast.unparse(node.func) in DANGEROUS_CALLS:
            found.append(ast.unparse(node.func))
    return found


def selfcheck() -> dict:
    """Audit the library's own modules: no network, no shell, no evaluated code."""
    findings = {str(p): bad for p in sorted(Path(__file__).parent.rglob("*.py")) if (bad := audit(p.read_text()))}
    return {"ok": not findings, "findings": findings}


# Three exports of five rows (a name with spaces, one with a full-width space, a blank phone, people missing here and there),
# and three of two people in other formats.
DEMO = {
    "recruit.csv": "姓名,手机,应聘岗位\n张三,13800000001,产品经理\n 李四 ,13800000002,设计师\n王五,13800000003,工程师\n赵六,,运营\n钱七,13800000007,工程师\n",
    "attend.csv": "员工姓名,部门,工号\n张三,产品部,EMP-1001\n李四,设计部,EMP-1002\n王　五,技术部,EMP-1003\n孙八,市场部,EMP-1008\n赵六,运营部,EMP-1006\n",
    "train.csv": "姓名,完成课程,证书\n张三,入职培训,A\n李四,入职培训,A\n王五,安全培训,B\n周九,入职培训,A\n钱七,,C\n",
}
OTHER_DEMO = ("旧系统导出.xls", "培训平台导出.ods", "考勤导出.tsv")
PEOPLE = ("张三", "李四")


def html_export() -> bytes:
    rows = "".join(f"<tr><td>{p}</td><td>1380000000{i}</td></tr>" for i, p in enumerate(PEOPLE, 1))
    return f"<html><body><table><tr><th>姓名</th><th>手机</th></tr>{rows}</table></body></html>".encode()


def ods_export() -> bytes:
    def row(*cells: str) -> str:
        return "<table:table-row>" + "".join(f'<table:table-cell office:value-type="string"><text:p>{c}</text:p></table:table-cell>' for c in cells) + "</table:table-row>"

    spaces = " ".join(f'xmlns:{x}="urn:oasis:names:tc:opendocument:xmlns:{x}:1.0"' for x in ("office", "table", "text"))
    table = row("姓名", "完成课程") + "".join(row(p, "入职培训") for p in PEOPLE)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        box.writestr("content.xml", f'<office:document-content {spaces}><office:body><office:spreadsheet><table:table table:name="S">{table}</table:table></office:spreadsheet></office:body></office:document-content>')
    return out.getvalue()


def demo_merge(spark, folder: str, files: dict[str, bytes], keys: tuple[str, ...]) -> tuple[dict, dict, list[dict]]:
    """Profile, merged report, and the rows of the result sheet as they read back."""
    paths = [str(Path(folder, name)) for name in files]
    for path, raw in zip(paths, files.values()):
        Path(path).write_bytes(raw)
    profile = run.inspect(spark, paths, 2)
    plan = {"primary": next(iter(files)), "tables": [{"path": p, "key_col": k} for p, k in zip(paths, keys)]}
    out = str(Path(folder, f"{next(iter(files))}-merged.xlsx"))
    report = run.merge(spark, MergePlan.of(plan), out)
    return profile, report, [r.asDict() for r in read_table(spark, out).df.collect()]


def selftest(spark) -> dict:
    """The demo exports end to end, then a merge across formats; raises AssertionError where a result is wrong."""
    with tempfile.TemporaryDirectory() as folder:
        profile, report, rows = demo_merge(spark, folder, {n: t.encode("utf-8-sig") for n, t in DEMO.items()}, ("姓名", "员工姓名", "姓名"))
        found = run.suggest_keys(spark, profile)
        assert found["candidates"] and found["candidates"][0]["score"] >= 0.5, found["candidates"][:1]
        assert (report["n_keys"], report["n_unmatched"], len(rows)) == (7, 6, 7), report
        tsv = "\n".join(["姓名\t部门", *(f"{p}\t{d}" for p, d in zip(PEOPLE, ("产品部", "设计部")))]).encode("utf-8-sig")
        profile, other, rows = demo_merge(spark, folder, dict(zip(OTHER_DEMO, (html_export(), ods_export(), tsv))), ("姓名",) * 3)
        formats = [t["format"] for t in profile["tables"]]
        assert formats == ["html", "ods", "delimited"], formats
        assert (other["n_keys"], other["n_result_rows"], other["n_conflicts"]) == (2, 2, 0), other
        first = next(r for r in rows if r[KEY] == PEOPLE[0])
        assert {"产品部", "入职培训"} <= set(first.values()), first
        assert all("冲突" not in r[STATUS] for r in rows), rows
        assert selfcheck()["ok"], "selfcheck"
    return {"ok": True, "n_keys": report["n_keys"], "n_unmatched": report["n_unmatched"], "formats_checked": formats, "n_keys_cross_format": other["n_keys"], "top_evidence": found["candidates"][0]["evidence"]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="keyloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("inspect", help="profile two or more tables")
    p.add_argument("names", nargs="*", metavar="file")
    p.add_argument("--files", nargs="+", default=[])
    p.add_argument("--sample", type=int, default=5)
    p.add_argument("--out")
    backend(p)
    p = sub.add_parser("suggest-keys", help="score key columns of profiled tables")
    p.add_argument("--profile", required=True)
    p.add_argument("--out")
    p = sub.add_parser("merge", help="merge by a confirmed plan")
    p.add_argument("--plan", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--recipe")
    p.add_argument("--save-recipe")
    p.add_argument("--tables-out", help="folder for the three tables as Parquet")
    backend(p)
    sub.add_parser("selfcheck")
    backend(sub.add_parser("selftest"))
    return top


def backend(p: argparse.ArgumentParser) -> None:
    """All known spellings are taken; there is one reader and one writer, so they all mean these."""
    p.add_argument("--backend", default="auto", choices=("auto", "stdlib", "openpyxl"))


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: an input can't be used; 3: the self-test failed."""
    args = parser().parse_args(argv)
    try:
        if args.command == "inspect":
            got = run.inspect(session(), [*args.names, *args.files], args.sample)
        elif args.command == "suggest-keys":
            got = run.suggest_keys(session(), load_json(args.profile, "profile"))  # type: ignore[arg-type]
        elif args.command == "merge":
            got = run.merge(session(), MergePlan.load(args.plan), args.out, args.recipe, args.save_recipe, args.tables_out)
        else:
            got = selfcheck() if args.command == "selfcheck" else selftest(session())
        if getattr(args, "out", None) and args.command != "merge":
            dump_json(got, args.out)
    except MergeInputError as e:
        print(f"[错误] {e}", file=sys.stderr)
        return 2
    except AssertionError as e:
        print(f"[自测失败] {e}", file=sys.stderr)
        return 3
    if args.command == "inspect":
        got = {"tables": [{k: t[k] for k in ("file", "format", "n_rows", "n_cols", "headers")} for t in got["tables"]]}
    elif args.command == "suggest-keys":
        got = {"n_candidates": len(got["candidates"]), "recommendation": got["recommendation"]}
    print(json.dumps(got, ensure_ascii=False, indent=2))
    return 0 if got.get("ok", True) else 3


if __name__ == "__main__":
    sys.exit(main())
