"""The three user-facing steps: profile tables, suggest keys, merge by a confirmed plan."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import SparkSession

from ..errors import MergeInputError
from ..lexicon import POLICIES, SHEETS, UNMATCHED_HEADERS
from ..operators.keys import suggest
from ..operators.merge import Merge, Source
from ..sinks.workbook import Sheet, write_workbook
from ..sources.reader import ROW, Table, read_table
from .plan import MergePlan, check_recipe, dump_json, load_json, recipe_of

TOOL, VERSION = "keyloom", "0.1.0"
LOGGED_CONFLICTS, LOGGED_KEYS = 50, 5


def stamp() -> dict:
    return {"tool": TOOL, "version": VERSION, "created": f"{datetime.now():%Y-%m-%d %H:%M:%S}"}


def read_all(spark: SparkSession, paths: list[str]) -> list[Table]:
    if len(paths) < 2:
        raise MergeInputError("至少需要 2 个表格文件。")
    full = [p if "://" in p else os.path.abspath(p) for p in paths]
    repeated = next((p for p in full if full.count(p) > 1), None)
    if repeated:
        raise MergeInputError(f"输入文件重复：{repeated}")
    return [read_table(spark, p) for p in full]


def inspect(spark: SparkSession, paths: list[str], sample: int = 5) -> dict:
    """A profile of each table with its first rows."""
    tables = []
    for t in read_all(spark, paths):
        first = t.df.orderBy(ROW).limit(max(0, sample)).drop(ROW).collect()
        tables.append(t.info.profile() | {"sample": [r.asDict() for r in first]})
    return stamp() | {"sample_n": sample, "tables": tables}


def suggest_keys(spark: SparkSession, profile: dict) -> dict:
    if len(profile.get("tables", [])) < 2:
        raise MergeInputError("profile 中表格不足 2 个。")
    found = suggest([read_table(spark, t["path"]) for t in profile["tables"]])
    return stamp() | {"candidates": found.rows, "recommendation": found.recommendation, "hint": "请用户确认关联键后再写入 plan.json；不要跳过确认直接合并。"}


def merge_of(spark: SparkSession, plan: MergePlan) -> Merge:
    tables = read_all(spark, [t.path for t in plan.tables])
    return Merge([Source(t, p.key_col, p.fields) for t, p in zip(tables, plan.tables)], plan.primary, plan.policy)


def log_rows(merge: Merge, counts: dict, recipe: str | None) -> list[list[str]]:
    """The audit log as 项目 / 内容 rows."""
    infos = [s.table.info for s in merge.sources]
    rows = [
        ["合并日志", ""],
        ["执行时间", stamp()["created"]],
        ["脚本版本", f"{TOOL} {VERSION}（读取后端：spark）"],
        ["关联键选择", "；".join(f"{s.file}[{s.key_col}]" for s in merge.sources)],
        ["主表", merge.primary],
        ["未匹配处置策略", POLICIES[merge.policy]],
        ["配方", recipe or "未使用（本次为人工确认）"],
        ["", ""],
        ["输入文件", "行数 / 列数 / 说明"],
    ]
    for s, info in zip(merge.sources, infos):
        notes = [f"{label} {v}" for label, v in (("编码", info.encoding), ("工作表", info.sheet)) if v]
        rows.append([f"{s.file}（键列：{s.key_col}）", f"{info.n_rows} 行 / {info.n_cols} 列" + (f"（{'，'.join(notes)}）" if notes else "")])
    rows += [["", ""], ["匹配统计", ""]]
    rows += [[label, str(counts[k])] for label, k in (("全局不同关联键数", "n_keys"), ("结果表行数", "n_result_rows"), ("未匹配记录条数", "n_unmatched"), ("字段冲突条数", "n_conflicts"))]
    for i, info in enumerate(infos):
        n = counts[f"matched_{i}"]
        rows.append([f"表 {info.file} 匹配覆盖", f"{n}/{info.n_rows}（{n * 100 / info.n_rows if info.n_rows else 0:.1f}%）"])
    rows.append(["表内重复键", ""])
    quiet = True
    for i, f in enumerate(merge.files):
        dups = merge.duplicate_keys(i)
        if n := dups.count():
            quiet = False
            first = [r.key for r in dups.orderBy("first").limit(LOGGED_KEYS).collect()]
            rows.append([f"表 {f}", f"{n} 组重复（示例：{first}），已全部保留请人工核对"])
    if quiet:
        rows.append(["（无）", "各表键列均唯一"])
    rows.append(["空键值（键列为空）", ""])
    rows += [[f"表 {f}", f"{merge.blank_keys(i).count()} 行键列为空，未参与匹配"] for i, f in enumerate(merge.files)]
    rows += [["", ""], ["字段冲突清单（均已保留原值、仅标记）", ""]]
    clashes = merge.conflicts().limit(LOGGED_CONFLICTS).collect()
    rows += [[f"{c[0]} / {c[1]}", c[2]] for c in clashes] or [["（无）", "多表同名字段取值一致或仅单表有值"]]
    if counts["n_conflicts"] > LOGGED_CONFLICTS:
        rows.append(["……", f"共 {counts['n_conflicts']} 条，仅展示前 {LOGGED_CONFLICTS} 条"])
    return [*rows, ["", ""], ["免责声明", "本日志为责任记录：不判断数据对错、不承诺一次合并永远正确；请先核对本日志与“未匹配记录”，再使用汇总结果。"]]


def merge(spark: SparkSession, plan: MergePlan, out: str, recipe_path: str | None = None, save_recipe: str | None = None, tables_out: str | None = None) -> dict:
    """Write the workbook and the report; ``tables_out`` also gets the three tables as Parquet."""
    used = check_recipe(plan, load_json(recipe_path, "recipe")) if recipe_path else None
    m = merge_of(spark, plan).persist()
    counts = m.counts().first().asDict()
    result, unmatched = m.result(), m.unmatched()
    write_workbook(
        out,
        [
            Sheet(SHEETS[0], result.columns, result.toLocalIterator()),
            Sheet(SHEETS[1], ["项目", "内容"], log_rows(m, counts, used)),
            Sheet(SHEETS[2], list(UNMATCHED_HEADERS), unmatched.toLocalIterator()),
        ],
    )
    if tables_out:
        for name, df in (("result", m.result(ordered=False)), ("unmatched", m.unmatched(ordered=False)), ("conflicts", m.conflicts(ordered=False))):
            df.write.mode("overwrite").parquet(f"{tables_out}/{name}")
    m.unpersist()
    report = stamp() | {"backend": "spark", "output": os.path.abspath(out)}
    report |= {k: counts[k] for k in ("n_keys", "n_result_rows", "n_unmatched", "n_conflicts")}
    report |= {"matched_per_file": {f: counts[f"matched_{i}"] for i, f in enumerate(m.files)}, "policy": plan.policy, "recipe": used}
    path = os.path.splitext(out)[0] + ".report.json"
    try:
        dump_json(report, path)
        report["report_path"] = os.path.abspath(path)
    except OSError:
        pass
    if save_recipe:
        dump_json(recipe_of(plan, m.files, stamp()), save_recipe)
        report["recipe_saved"] = os.path.abspath(save_recipe)
    return report
