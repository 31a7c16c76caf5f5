"""Words and patterns that decide how headers and keys are read."""

from __future__ import annotations

from dataclasses import dataclass

# The header words, synonym groups and patterns that results depend on.
NAME_HINTS = ("姓名", "名字", "员工姓名", "人员姓名", "花名", "员工", "人员", "name")
ID_HINTS = ("工号", "员工号", "员工编号", "编号", "工卡", "备案号", "id")
CONTACT_HINTS = ("手机", "电话", "联系", "邮箱", "微信", "身份证")
SYNONYMS = (
    ("联系方式", ("手机", "手机号", "移动电话", "电话", "联系电话", "联系方式", "联络方式", "通讯方式")),
    ("部门", ("部门", "所属部门", "所在部门")),
    ("姓名", ("姓名", "员工姓名", "人员姓名", "名字")),
    ("工号", ("工号", "员工号", "员工编号", "编号", "工卡")),
)
ID_PREFIX = r"^(EMP|E|NO\.?|工号|员工号|编号|ID|工卡)\s*[:：\-_#]?\s*"
ID_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9\-_]*$"
TRAILING_NOTE = r"[（(][^）)]{1,30}[）)]\s*$"
ALIAS_SEPARATORS = r"[、/，,;；|]"
ILLEGAL_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
LEADING_STAFF_WORD = r"^(员工|人员)"
ANY_NOTE = r"[（(].*[）)]"

KEY = "关联键"
STATUS = "数据状态"
COMPLETE = "完整匹配"
UNMATCHED_HEADERS = ("来源表", "原始键值", "归一化键值", "缺席表", "最相近候选")
SHEETS = ("汇总结果", "合并日志", "未匹配记录")
POLICIES = {"separate_sheet": "单独输出到“未匹配记录”sheet", "keep_marked": "保留在结果表并标记", "drop": "从结果表剔除（仍记入本日志备查）"}
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5")
EXTENSIONS = (".xlsx", ".xlsm", ".xls", ".ods", ".csv", ".tsv", ".txt")


@dataclass(frozen=True)
class Lexicon:
    """The extension point: pass another one to classify other headers."""

    name_hints: tuple[str, ...] = NAME_HINTS
    id_hints: tuple[str, ...] = ID_HINTS
    contact_hints: tuple[str, ...] = CONTACT_HINTS
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = SYNONYMS


DEFAULT = Lexicon()
