"""Registered queries over the Parquet test tables, and the same results as DuckDB SQL.

The tables stand in for exports: ``customer`` (key EMP-<id>), ``orders`` (key NO.<id>,
many rows a key) and ``events`` (plain ids, few keys) are the sources of one merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from . import queries_files
from .operators import keys, shape, similar
from .operators.merge import Merge, Source
from .plans.run import log_rows
from .sources.grids import html_table
from .sources.reader import Table, from_table

PREFIX = r"^(EMP|E|NO\.?|工号|员工号|编号|ID|工卡)\s*[:：\-_#]?\s*"
NOTE = r"[（(][^）)]{1,30}[）)]\s*$"
HALF, FULL = C.HALF, C.FULL


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_source(df: DataFrame, file: str, order: str, key: str, fields: list[str] | None = None, count: bool = False) -> Source:
    names = [c for c in df.columns if c != order]
    return Source(from_table(df, file, order, names, count), key, fields)


def sources(spark: SparkSession, sf: str, blanks: bool = False, count: bool = False) -> list[Source]:
    customer = load(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("EMP-"), "c_custkey").alias("工号"), F.col("c_name").alias("姓名"), F.col("c_nationkey").cast("string").alias("电话"), F.col("c_mktsegment").alias("部门")
    )
    key = F.concat(F.lit("NO."), "o_custkey")
    if blanks:
        key = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(key)
    orders = load(spark, sf, "orders").select("o_orderkey", key.alias("编号"), F.col("o_orderstatus").alias("状态"), (F.col("o_orderkey") % 25).cast("string").alias("联系电话"), F.col("o_orderpriority").alias("优先级"))
    events = load(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("事件"))
    return [
        text_source(customer, "customer", "c_custkey", "工号", count=count),
        text_source(orders, "orders", "o_orderkey", "编号", count=count),
        text_source(events, "events", "event_id", "user_id", count=count),
    ]


def merged(spark: SparkSession, sf: str, primary: str | None = None, policy: str = "separate_sheet", **params) -> Merge:
    return Merge(sources(spark, sf, **params), primary, policy, exact=False)


# ---- the same merge in SQL

BASE = f"""
    c AS (SELECT lower(regexp_replace('EMP-' || c_custkey, '{PREFIX}', '', 'i')) AS key, c_custkey AS idx, 'EMP-' || c_custkey AS raw, c_name AS "姓名", CAST(c_nationkey AS VARCHAR) AS "电话", c_mktsegment AS "部门" FROM customer),
    o AS (SELECT lower(regexp_replace('NO.' || o_custkey, '{PREFIX}', '', 'i')) AS key, o_orderkey AS idx, 'NO.' || o_custkey AS raw, o_orderstatus AS "状态", CAST(o_orderkey % 25 AS VARCHAR) AS "联系电话", o_orderpriority AS "优先级" FROM orders),
    e AS (SELECT lower(regexp_replace(CAST(user_id AS VARCHAR), '{PREFIX}', '', 'i')) AS key, event_id AS idx, CAST(user_id AS VARCHAR) AS raw, event_type AS "事件" FROM events),
    c1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx) = 1),
    o1 AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx) = 1),
    e1 AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx) = 1),
    k AS (SELECT key FROM c1 UNION SELECT key FROM o1 UNION SELECT key FROM e1),
    m AS (
      SELECT k.key, c1.key IS NOT NULL AS pc, o1.key IS NOT NULL AS po, e1.key IS NOT NULL AS pe,
             c1.idx AS ci, o1.idx AS oi, e1.idx AS ei, c1.raw AS craw, o1.raw AS oraw, e1.raw AS eraw,
             coalesce("姓名", '') AS "姓名", coalesce("电话", '') AS "电话", coalesce("部门", '') AS "部门",
             coalesce("状态", '') AS "状态", coalesce("联系电话", '') AS "联系电话", coalesce("优先级", '') AS "优先级", coalesce("事件", '') AS "事件"
      FROM k LEFT JOIN c1 USING (key) LEFT JOIN o1 USING (key) LEFT JOIN e1 USING (key)
    ),
    s AS (
      SELECT *, pc AND po AND pe AS every,
             concat_ws('、', CASE WHEN NOT pc THEN 'customer' END, CASE WHEN NOT po THEN 'orders' END, CASE WHEN NOT pe THEN 'events' END) AS missing,
             "电话" <> '' AND "联系电话" <> '' AND "电话" <> "联系电话" AS clash
      FROM m
    ),
    t AS (
      SELECT *, coalesce(nullif(concat_ws('；', CASE WHEN NOT every THEN '部分缺失（缺：' || missing || '）' END, CASE WHEN clash THEN '冲突：联系方式' END), ''), '完整匹配') AS status FROM s
    )
"""
WIDE = """SELECT key AS "关联键", "姓名" AS "姓名（来源：customer）", "电话" AS "电话（来源：customer）", "部门" AS "部门（来源：customer）",
    "状态" AS "状态（来源：orders）", "联系电话" AS "联系电话（来源：orders）", "优先级" AS "优先级（来源：orders）", "事件" AS "事件（来源：events）", status AS "数据状态" FROM t"""


def base(sql: str) -> str:
    return f"WITH {BASE} {sql}"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(base(WIDE))
def merge_full_outer(spark, sf):
    return merged(spark, sf).result(ordered=False)


@query(base(WIDE))
def merge_full_outer_exact(spark, sf):
    """By the exact text rules, as the command line merges."""
    return Merge(sources(spark, sf)).result(ordered=False)


@query(base(WIDE).replace(f"lower(regexp_replace('EMP-' || c_custkey, '{PREFIX}', '', 'i')) AS key", "'EMP-' || c_custkey AS key"))
def merge_mixed_kinds(spark, sf):
    """One source's key is a name, so its prefix and case stay."""
    c, o, e = sources(spark, sf)
    return Merge([Source(c.table, c.key_col, kind="name"), o, e], exact=False).result(ordered=False)


@query(base('SELECT key AS "关联键", status AS "数据状态" FROM t'))
def merge_status(spark, sf):
    return merged(spark, sf).result(ordered=False).select("关联键", "数据状态")


@query(base(WIDE + " WHERE every"))
def merge_policy_drop(spark, sf):
    return merged(spark, sf, policy="drop").result(ordered=False)


@query(base(WIDE))
def merge_policy_keep_marked(spark, sf):
    return merged(spark, sf, policy="keep_marked").result(ordered=False)


@query(base(WIDE))
def merge_policy_separate_sheet(spark, sf):
    return merged(spark, sf, policy="separate_sheet").result(ordered=False)


@query(base("SELECT key, CAST(CASE WHEN po THEN 0 WHEN pc THEN 1 ELSE 3 END AS INTEGER) AS source_rank, CASE WHEN po THEN oi WHEN pc THEN ci ELSE ei END AS row_idx FROM t"))
def merge_primary_order(spark, sf):
    return merged(spark, sf, primary="orders").merged.select("key", F.col("ord.rank").alias("source_rank"), F.col("ord.row").alias("row_idx"))


@query(base('SELECT key AS "关联键", "部门" AS "部门（来源：customer）", "优先级" AS "优先级（来源：orders）", status AS "数据状态" FROM (SELECT * REPLACE (coalesce(CASE WHEN NOT every THEN \'部分缺失（缺：\' || missing || \'）\' END, \'完整匹配\') AS status) FROM t)'))
def merge_fields_subset(spark, sf):
    c, o, e = sources(spark, sf)
    picked = [Source(c.table, c.key_col, ["部门", "没有"]), Source(o.table, o.key_col, ["优先级", "编号"]), Source(e.table, e.key_col, ["没有"])]
    return Merge(picked, exact=False).result(ordered=False)


@query(base("""SELECT key AS "关联键", '联系方式' AS "逻辑字段", '电话（来源：customer）=' || "电话" || '；联系电话（来源：orders）=' || "联系电话" AS "取值" FROM t WHERE clash"""))
def merge_conflicts(spark, sf):
    return merged(spark, sf).conflicts(ordered=False)


@query(base("""SELECT * FROM (
      SELECT 'customer' AS "来源表", craw AS "原始键值", key AS "归一化键值", missing AS "缺席表" FROM t WHERE pc AND NOT every
      UNION ALL SELECT 'orders', oraw, key, missing FROM t WHERE po AND NOT every
      UNION ALL SELECT 'events', eraw, key, missing FROM t WHERE pe AND NOT every)"""))
def merge_unmatched(spark, sf):
    return merged(spark, sf).unmatched(similar=False, ordered=False).drop("最相近候选")


@query()
def merge_unmatched_closest(spark, sf):
    """With each record's closest candidates among all keys of the merge."""
    return merged(spark, sf).unmatched(ordered=False)


@query(base("""SELECT 'customer' AS file, (SELECT count(*) FROM c1) AS matched, (SELECT count(*) FROM customer) AS n_rows
      UNION ALL SELECT 'orders', (SELECT count(*) FROM o1), (SELECT count(*) FROM orders)
      UNION ALL SELECT 'events', (SELECT count(*) FROM e1), (SELECT count(*) FROM events)"""))
def merge_coverage(spark, sf):
    m = merged(spark, sf)
    out = m.counts().select(F.explode(F.array(*[F.struct(F.lit(f).alias("file"), F.col(f"matched_{i}").alias("matched")) for i, f in enumerate(m.files)])).alias("x")).select("x.*")
    rows = None
    for s in m.sources:
        part = s.table.df.agg(F.count("*").alias("n_rows")).select(F.lit(s.file).alias("f"), "n_rows")
        rows = part if rows is None else rows.unionByName(part)
    return out.join(rows, F.col("file") == F.col("f")).select("file", "matched", "n_rows")


@query(base("""SELECT count(*) AS n_keys, count(*) AS n_result_rows,
      CAST(sum(CASE WHEN every THEN 0 ELSE pc::INT + po::INT + pe::INT END) AS BIGINT) AS n_unmatched, CAST(sum(clash::INT) AS BIGINT) AS n_conflicts,
      CAST(sum(pc::INT) AS BIGINT) AS matched_0, CAST(sum(po::INT) AS BIGINT) AS matched_1, CAST(sum(pe::INT) AS BIGINT) AS matched_2 FROM t"""))
def merge_report_counts(spark, sf):
    return merged(spark, sf).counts()


@query(base("""SELECT * FROM (
      SELECT '全局不同关联键数' AS "项目", CAST(count(*) AS VARCHAR) AS "内容" FROM t
      UNION ALL SELECT '结果表行数', CAST(count(*) AS VARCHAR) FROM t
      UNION ALL SELECT '未匹配记录条数', CAST(sum(CASE WHEN every THEN 0 ELSE pc::INT + po::INT + pe::INT END) AS VARCHAR) FROM t
      UNION ALL SELECT '字段冲突条数', CAST(sum(clash::INT) AS VARCHAR) FROM t
      UNION ALL SELECT '表 customer', '0 行键列为空，未参与匹配' UNION ALL SELECT '表 orders', '0 行键列为空，未参与匹配' UNION ALL SELECT '表 events', '0 行键列为空，未参与匹配'
      UNION ALL SELECT '关联键选择', 'customer[工号]；orders[编号]；events[user_id]'
      UNION ALL SELECT '未匹配处置策略', '单独输出到“未匹配记录”sheet')"""))
def merge_log_rows(spark, sf):
    """The log's rows that don't depend on time, row examples or rounding."""
    m = merged(spark, sf, count=True)
    counts = m.counts().first().asDict()
    kept = {"全局不同关联键数", "结果表行数", "未匹配记录条数", "字段冲突条数", "关联键选择", "未匹配处置策略"}
    rows = [r for r in log_rows(m, counts, None) if r[0] in kept or "行键列为空" in str(r[1])]
    return spark.createDataFrame(rows, '`项目` string, `内容` string')


@query(f"""SELECT key, count(*) AS n, min(o_orderkey) AS first FROM (
      SELECT lower(regexp_replace('NO.' || o_custkey, '{PREFIX}', '', 'i')) AS key, o_orderkey FROM orders) GROUP BY key HAVING count(*) > 1""")
def dup_key_groups(spark, sf):
    return merged(spark, sf).duplicate_keys(1)


@query("""SELECT 'customer' AS file, CAST(0 AS BIGINT) AS null_keys UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'events', CAST(0 AS BIGINT)""")
def null_key_counts(spark, sf):
    m = merged(spark, sf, blanks=True)
    out = None
    for i, f in enumerate(m.files):
        part = m.blank_keys(i).agg(F.count("*").alias("null_keys")).select(F.lit(f).alias("file"), "null_keys")
        out = part if out is None else out.unionByName(part)
    return out


# ---- key suggestion

ID_COLUMNS = [("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("conversations", "conv_id"), ("benchmark", "item_id"), ("embeddings", "vec_id"), ("events", "event_id"), ("events", "user_id")]
NAME_COLUMNS = [("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"), ("region", "r_name"), ("part", "p_name")]


def key_tables(spark: SparkSession, sf: str, columns: list[tuple[str, str]]) -> list[Table]:
    out = []
    for name in dict.fromkeys(t for t, _ in columns):
        df = load(spark, sf, name)
        names = [c for t, c in columns if t == name]
        out.append(from_table(df.select(*names, F.lit(0).alias("o")), name, "o", names))
    return out


def overlap_sql(columns: list[tuple[str, str]], kind: str) -> str:
    """Counts of every pair of columns of different tables."""
    tables = list(dict.fromkeys(t for t, _ in columns))
    parts = []
    for i, (t, c) in enumerate(columns):
        text = f"CAST({c} AS VARCHAR)"
        key = f"regexp_replace(regexp_replace({text}, '\\s+', '', 'g'), '{NOTE}', '')"
        key = f"lower(regexp_replace({key}, '{PREFIX}', '', 'i'))" if kind == "id" else key
        parts.append(f"SELECT {i} AS col, {tables.index(t)} AS t, '{t}.{c}' AS name, {key} AS key FROM {t} WHERE {c} IS NOT NULL AND trim({text}) <> ''")
    return f"""WITH v AS ({' UNION ALL '.join(parts)}),
      st AS (SELECT col, t, name, count(*) AS n, count(DISTINCT key) AS u FROM v GROUP BY ALL),
      d AS (SELECT DISTINCT col, key FROM v),
      ov AS (SELECT a.col AS x, b.col AS y, count(*) AS overlap FROM d a JOIN d b USING (key) GROUP BY ALL)
      SELECT a.name AS a, b.name AS b, a.u AS a_unique, b.u AS b_unique, a.n - a.u AS a_dup, b.n - b.u AS b_dup, coalesce(overlap, 0) AS overlap"""


def overlap_query(spark, sf, columns):
    tables = key_tables(spark, sf, columns)
    found = keys.key_columns(tables)
    pairs = keys.overlaps(keys.key_counts(tables, found, exact=False), found)
    names = F.array(*[F.lit(f"{tables[t].info.file}.{tables[t].info.headers[c]}") for t, c, _ in found])
    return pairs.withColumn("a", F.get(names, F.col("i"))).withColumn("b", F.get(names, F.col("j")))


FROM_PAIRS = " FROM st a JOIN st b ON a.t < b.t LEFT JOIN ov ON ov.x = a.col AND ov.y = b.col"


def overlap_counts(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select("a", "b", F.col("a_uniques").alias("a_unique"), F.col("b_uniques").alias("b_unique"), (F.col("a_n") - F.col("a_uniques")).alias("a_dup"), (F.col("b_n") - F.col("b_uniques")).alias("b_dup"), "overlap", *more)


@query(overlap_sql(ID_COLUMNS, "id") + FROM_PAIRS)
def key_overlap_ids(spark, sf):
    return overlap_counts(overlap_query(spark, sf, ID_COLUMNS))


@query(overlap_sql(NAME_COLUMNS, "name") + FROM_PAIRS)
def key_overlap_names(spark, sf):
    return overlap_counts(overlap_query(spark, sf, NAME_COLUMNS))


RATES = """, round_even(coalesce(overlap, 0) / a.u, 4) AS rate_a, round_even(coalesce(overlap, 0) / b.u, 4) AS rate_b, round_even(coalesce(overlap, 0) / (a.u + b.u - coalesce(overlap, 0)), 4) AS jaccard"""


@query(overlap_sql(ID_COLUMNS, "id") + RATES + FROM_PAIRS)
def key_candidates_stats(spark, sf):
    p = overlap_query(spark, sf, ID_COLUMNS)
    rate = lambda d: F.bround(F.col("overlap") / d, 4)
    a, b = F.col("a_uniques"), F.col("b_uniques")
    return overlap_counts(p, rate(a).alias("rate_a"), rate(b).alias("rate_b"), rate(a + b - F.col("overlap")).alias("jaccard"))


@query(f"""WITH p AS ({overlap_sql(ID_COLUMNS, "id")}, a.n AS a_n, b.n AS b_n, a.col AS i, b.col AS j {FROM_PAIRS}),
      r AS (SELECT *, round_even(overlap / a_unique, 4) AS ra, round_even(overlap / b_unique, 4) AS rb, round_even(overlap / (a_unique + b_unique - overlap), 4) AS jaccard,
                   1 - (a_dup / a_n + b_dup / b_n) / 2 AS uniq FROM p),
      s AS (SELECT *, floor((CAST(0.6 AS DOUBLE) * least(ra, rb) + CAST(0.25 AS DOUBLE) * jaccard + CAST(0.15 AS DOUBLE) * uniq) * CAST(10000 AS DOUBLE) + CAST(0.5000001 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS score FROM r)
      SELECT a, b, overlap, score, CAST(row_number() OVER (ORDER BY score DESC, i, j) AS INTEGER) AS rank FROM s""")
def key_candidates_ranked(spark, sf):
    return keys.ranked(overlap_query(spark, sf, ID_COLUMNS)).select("a", "b", "overlap", "score", "rank")


@query("""SELECT 'customer' AS side, CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS rank, key FROM (
        SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer EXCEPT SELECT CAST(user_id AS VARCHAR) FROM events ORDER BY key LIMIT 5)
      UNION ALL SELECT 'events', CAST(row_number() OVER (ORDER BY key) AS INTEGER), key FROM (
        SELECT CAST(user_id AS VARCHAR) AS key FROM events EXCEPT SELECT CAST(c_custkey AS VARCHAR) FROM customer ORDER BY key LIMIT 5)""")
def key_only_examples(spark, sf):
    tables = [from_table(load(spark, sf, t).select(F.col(c).alias("id"), F.lit(0).alias("o")), t, "o", ["id"]) for t, c in (("customer", "c_custkey"), ("events", "user_id"))]
    columns = keys.key_columns(tables)
    found = keys.only_examples(keys.key_counts(tables, columns, exact=False), columns)
    return found.select(F.when(F.col("i") == 0, "customer").otherwise("events").alias("side"), "rank", "key")


# ---- headers and scalars

HEADERS = ["姓名", "员工姓名", "name", "Customer Name", "工号", "员工编号", "ID", "width", "c_custkey", "手机号", "联系电话", "邮箱", "部门", "所属部门", "金额", "姓名（曾用）", "c_name", "doc_id", "人员", "微信"]
HEADER_VALUES = "(VALUES " + ", ".join(f"({literal(h)})" for h in HEADERS) + ") AS v(header)"


def contains_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(w)})" for w in words) + ")"


def header_frame(spark) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HEADERS], "header string")


@query(f"""SELECT header, CASE WHEN {contains_any('lower(header)', C.DEFAULT.id_hints)} THEN 'id' WHEN {contains_any('lower(header)', C.DEFAULT.name_hints)} THEN 'name'
      WHEN {contains_any('header', C.DEFAULT.contact_hints)} THEN 'contact' ELSE 'other' END AS kind FROM {HEADER_VALUES}""")
def col_kind_classify(spark, sf):
    return header_frame(spark).select("header", C.header_kind(F.col("header")).alias("kind"))


@query(f"""SELECT header, CASE {' '.join(f"WHEN {contains_any('header', words)} OR {contains_any('bare', words)} THEN {literal(field)}" for field, words in C.DEFAULT.synonyms)} ELSE bare END AS field
      FROM (SELECT header, lower(regexp_replace(regexp_replace(regexp_replace(header, '[（(].*[）)]', ''), '^(员工|人员)', ''), '\\s+', '', 'g')) AS bare FROM {HEADER_VALUES})""")
def logic_field_classify(spark, sf):
    return header_frame(spark).select("header", C.logical_field(F.col("header")).alias("field"))


def decorated(spark, sf) -> DataFrame:
    """Keys as exports write them: prefixes, notes, full-width forms, odd white space."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit(" EMP-"), k)).when(k % 5 == 1, F.concat(F.lit("工号："), k)).when(k % 5 == 2, F.concat(F.lit("No."), k, F.lit("（旧）"))).when(k % 5 == 3, F.concat(F.lit("　"), F.col("c_name"), F.lit(" (x)"))).otherwise(F.translate(F.concat(F.lit("id_A"), k), HALF, FULL))
    return load(spark, sf, "customer").select("c_custkey", raw.alias("raw"))


DECORATED = f"""(SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' EMP-' || c_custkey WHEN 1 THEN '工号：' || c_custkey WHEN 2 THEN 'No.' || c_custkey || '（旧）'
      WHEN 3 THEN '　' || c_name || ' (x)' ELSE translate('id_A' || c_custkey, {literal(HALF)}, {literal(FULL)}) END AS raw FROM customer)"""
HALVED = f"translate(raw, {literal(FULL)}, {literal(HALF)})"
SQUEEZED = f"regexp_replace({HALVED}, '[\\s　]+', '', 'g')"
BARE = f"regexp_replace({SQUEEZED}, '{NOTE}', '')"
AS_ID = f"lower(regexp_replace({BARE}, '{PREFIX}', '', 'i'))"


def scalar(name: str, sql: str, f) -> None:
    def run(spark, sf):
        return decorated(spark, sf).select("c_custkey", f(F.col("raw")).alias("value"))

    run.__name__ = name
    query(f"SELECT c_custkey, {sql} AS value FROM {DECORATED}")(run)


scalar("norm_key_id", AS_ID, lambda c: C.norm_key(c, "id"))
scalar("norm_key_name", BARE, lambda c: C.norm_key(c, "name"))
scalar("norm_key_auto", f"CASE WHEN regexp_matches({BARE}, '^[A-Za-z0-9][A-Za-z0-9\\-_]*$') THEN {AS_ID} ELSE {BARE} END", lambda c: C.norm_key(c, "auto"))
scalar("norm_key_id_exact", AS_ID, lambda c: C.norm_key_exact(c, "id"))
FOLDED = f"replace({AS_ID.replace('raw', "('Straße' || raw)")}, 'ß', 'ss')"
scalar("norm_key_casefold", FOLDED, lambda c: C.norm_key_exact(F.concat(F.lit("Straße"), c), "id"))
scalar("norm_text_fullwidth", f"regexp_replace({HALVED}, '^[\\s　]+|[\\s　]+$', '', 'g')", C.norm_text)
scalar("norm_text_exact", f"regexp_replace({HALVED}, '^[\\s　]+|[\\s　]+$', '', 'g')", C.norm_text_exact)
scalar("squeeze_ws", SQUEEZED, C.squeeze)
scalar("strip_trailing_paren", f"regexp_replace(raw, '{NOTE}', '')", C.strip_note)
scalar("strip_id_prefix", f"regexp_replace(raw, '{PREFIX}', '', 'i')", C.strip_prefix)


@query("""SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || '、x ; ' || p_brand || '|', '[、/，,;；|]'), lambda x: trim(x)), lambda x: x <> '') AS aliases FROM part""")
def split_aliases(spark, sf):
    raw = F.concat("p_name", F.lit("、x ; "), "p_brand", F.lit("|"))
    return load(spark, sf, "part").select("p_partkey", C.aliases(raw).alias("aliases"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey * 1000 AS VARCHAR) WHEN 2 THEN '-' || o_orderkey || '.5' ELSE 'n' || o_orderkey END AS value FROM orders""")
def num_text(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(k, F.lit(".000"))).when(k % 4 == 1, F.concat(k, F.lit("E3"))).when(k % 4 == 2, F.concat(F.lit("-"), k, F.lit(".5"))).otherwise(F.concat(F.lit("n"), k))
    return load(spark, sf, "orders").select("o_orderkey", C.number_text(raw).alias("value"))


@query("SELECT n_nationkey, n_name || 'x' || chr(9) AS value FROM nation")
def clean_xml_chars(spark, sf):
    raw = F.concat(F.lit("\x01"), "n_name", F.lit("\x0bx\x1f\t"))
    return load(spark, sf, "nation").select("n_nationkey", C.clean_xml(raw).alias("value"))


# ---- shape

def nation_grid(spark, sf) -> DataFrame:
    """A title row, a blank row, a header and data, with an empty column in the middle."""
    nation = load(spark, sf, "nation").select((F.col("n_nationkey") + 3).cast("long").alias("row"), F.array("n_name", F.lit(""), F.col("n_regionkey").cast("string")).alias("cells"))
    top = spark.createDataFrame([(0, ["nations", "", ""]), (1, ["", "", ""]), (2, ["name", "", "region"])], "row long, cells array<string>")
    return top.unionByName(nation)


GRID = """(SELECT CAST(n_nationkey + 3 AS BIGINT) AS row, [n_name, '', CAST(n_regionkey AS VARCHAR)] AS cells FROM nation
      UNION ALL SELECT 0, ['nations', '', ''] UNION ALL SELECT 1, ['', '', ''] UNION ALL SELECT 2, ['name', '', 'region'])"""


@query(f"SELECT row, [cells[1], cells[3]] AS cells FROM {GRID}")
def drop_empty_cols(spark, sf):
    return shape.drop_empty_columns(nation_grid(spark, sf))


@query(f"SELECT min(row) AS row FROM {GRID} WHERE len(list_filter(cells, lambda x: x <> '')) >= 2 AND row < 10")
def header_locate(spark, sf):
    return shape.header_row(nation_grid(spark, sf))


@query(f"SELECT row, cells FROM {GRID} WHERE len(list_filter(cells, lambda x: x <> '')) > 0")
def blank_row_filter(spark, sf):
    return shape.blank_rows_out(nation_grid(spark, sf))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def row_sample(spark, sf):
    return shape.sample(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 5)


# ---- sets of keys

def key_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("key")), load(spark, sf, "events").select(F.col("user_id").alias("key"))


@query("SELECT c_custkey AS key FROM customer UNION SELECT user_id FROM events")
def set_union_keys(spark, sf):
    a, b = key_sets(spark, sf)
    return a.union(b).distinct()


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT user_id FROM events")
def set_intersect_keys(spark, sf):
    a, b = key_sets(spark, sf)
    return a.intersect(b)


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT user_id FROM events")
def set_except_keys(spark, sf):
    a, b = key_sets(spark, sf)
    return a.subtract(b)


# ---- similar keys

def typos(spark, sf) -> tuple[DataFrame, DataFrame]:
    pool = load(spark, sf, "nation").select(F.col("n_name").alias("key"))
    return pool.select(F.concat(F.substring("key", 2, 20), F.lit("X")).alias("key")), pool


@query()
def similar_keys_top3(spark, sf):
    return similar.closest(*typos(spark, sf))


CHARS = """SELECT DISTINCT {key} AS key, length({key}) AS n, unnest(string_split({key}, '')) AS ch, unnest(range(1, length({key}) + 1)) AS pos FROM nation"""


@query(f"""WITH a0 AS ({CHARS.format(key="substring(n_name, 2, 20) || 'X'")}), b0 AS ({CHARS.format(key="n_name")}),
      a AS (SELECT key, n, ch, row_number() OVER (PARTITION BY key, ch ORDER BY pos) AS nth FROM a0),
      b AS (SELECT key AS candidate, n AS m, ch, row_number() OVER (PARTITION BY key, ch ORDER BY pos) AS nth FROM b0)
      SELECT key, candidate, count(*) AS common FROM a JOIN b USING (ch, nth) WHERE key <> candidate GROUP BY key, candidate, n, m HAVING 2 * count(*) >= 0.5 * (n + m)""")
def similar_quick_ratio_block(spark, sf):
    return similar.shared_characters(*typos(spark, sf))


# ---- sources and profiles

@query("""SELECT r_regionkey AS region, CAST(1 AS BIGINT) AS row, [regexp_replace(r_name, '\\s+', '', 'g'), '', 'k' || r_regionkey] AS cells FROM region
      UNION ALL SELECT r_regionkey, 0, ['name', '', 'key'] FROM region""")
def html_table_scan(spark, sf):
    """A page with a table for each region; the table's rows by the HTML reader."""
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            out = [(i, n, r) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, r in enumerate(html_table("", h.encode())[0])]
            ids, rows, cells = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(rows, pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["region", "row", "cells"])

    page = F.concat(F.lit("<html><table><tr><th colspan=2>name<th>key</tr><tr><td> "), "r_name", F.lit("<script>x</script><td><table><tr><td>in</td></tr></table></td><td>k"), "r_regionkey", F.lit("</table><table><tr><td>2nd</td></tr></table>"))
    return load(spark, sf, "region").select(F.col("r_regionkey").cast("int"), page.alias("html")).mapInArrow(scan, "region int, row long, cells array<string>")


PROFILED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS file, (SELECT count(*) FROM {t}) AS n_rows, CAST({len(cols)} AS INTEGER) AS n_cols, '{c}' AS header, '{'id' if 'id' in c else 'name' if 'name' in c else 'other'}' AS kind" for t, cols in PROFILED.items() for c in cols))
def inspect_profile(spark, sf):
    out = None
    for name in PROFILED:
        df = load(spark, sf, name)
        heads = spark.createDataFrame([(c,) for c in df.columns], "header string").select("header", C.header_kind(F.col("header")).alias("kind"))
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("file"), "n_rows", F.lit(len(df.columns)).alias("n_cols")).crossJoin(heads)
        out = part if out is None else out.unionByName(part)
    return out


QUERIES |= queries_files.QUERIES
ORACLES |= queries_files.ORACLES
