"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, licenses, mixing, neardup, quality, substrings, tokens, toxicity, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_output": op2_token_output,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_main_text": op8_main_text,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
}

WORDS_SQL = r"regexp_extract_all(lower(coalesce({0}, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def word_list(words) -> str:
    return f"[{', '.join(repr(w) for w in sorted(words))}]"


def templates_sql() -> str:
    rows = [f"('{r.label}', {word_list(r.words)}, {r.need}, {word_list(r.telling)}, {r.need_telling}, {r.width})" for r in licenses.template_rows(licenses.TEMPLATES, 0.8)]
    return "(VALUES " + ", ".join(rows) + ") AS t(label, words, need, telling, need_telling, width)"


def vocabulary_sql() -> str:
    return word_list(set().union(*(r.words for r in licenses.template_rows(licenses.TEMPLATES, 0.8))))


def phrases_sql() -> str:
    tests = []
    for phrase, label in licenses.PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        tests.append(f"WHEN {same} THEN '{label}'")
    return "CASE " + " ".join(tests) + " END"


#: The SQL's own masks; the operator's seeds find every alignment at the threshold, so these rows too.
SQL_MASKS = ("1101011", "110010111")


def seeds_sql(table: str) -> str:
    """(id, pos, seed) of every window of a table with (id, w)."""
    parts = []
    for n, mask in enumerate(SQL_MASKS):
        picked = ", ".join(f"w[pos + {i + 1}]" for i, x in enumerate(mask) if x == "1")
        parts.append(f"SELECT id, pos, concat_ws(' ', '{n}', {picked}) AS seed FROM (SELECT id, w, unnest(range(0, len(w) - {len(mask) - 1})) AS pos FROM {table} WHERE len(w) >= {len(mask)})")
    return " UNION ALL ".join(parts)


ORACLES = {
    "op1_substring_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, unnest(range(1, octet_length(b) - 398)) AS i, b FROM d WHERE octet_length(b) >= 400),
        h AS (SELECT doc_id, i, md5(b[i : i + 399]) AS m FROM w),
        rep AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY m) > 1),
        mark AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS opens FROM rep),
        run AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark),
        span AS (SELECT doc_id, min(i) AS lo, max(i) + 399 AS hi FROM run GROUP BY doc_id, r),
        cut AS (
          SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS since FROM span
          UNION ALL SELECT doc_id, octet_length(b) + 1, NULL, coalesce((SELECT max(hi) FROM span s WHERE s.doc_id = d.doc_id), 0) + 1 FROM d
        ),
        kept AS (
          SELECT cut.doc_id, sha256(unhex(string_agg(CASE WHEN since < lo THEN hex(b[since : lo - 1]) ELSE '' END, '' ORDER BY lo, hi NULLS LAST))) AS kept_sha256,
                 coalesce(sum(hi - lo + 1), 0) AS n_removed, count(hi) AS n_spans
          FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY cut.doc_id
        ),
        w2 AS (SELECT doc_id, unnest(range(1, octet_length(b) - 278)) AS i, b FROM d WHERE octet_length(b) >= 280),
        h2 AS (SELECT doc_id, i, md5(b[i : i + 279]) AS m FROM w2),
        rep2 AS (SELECT doc_id, i FROM h2 QUALIFY count(*) OVER (PARTITION BY m) > 1),
        told AS (SELECT doc_id, sum(least(280, coalesce(next - i, 280))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM rep2) GROUP BY doc_id)
        SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, kept_sha256, CAST(coalesce(told.n, 0) AS BIGINT) AS n_passage_bytes
        FROM d JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
    """,
    "op4_license_scan": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL.format('text')} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        hit AS (SELECT doc_id, i - 1 AS pos, {phrases_sql()} AS label FROM p),
        base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS base FROM hit WHERE label IS NOT NULL GROUP BY doc_id),
        spot AS (SELECT doc_id, i, w[i] AS word, w[i : i + 99] AS ahead FROM p WHERE list_contains({vocabulary_sql()}, w[i])),
        win AS (SELECT doc_id, label, need, telling, need_telling, len(words) AS n, list_intersect(words, ahead[1 : width]) AS met FROM spot, {templates_sql()} WHERE list_contains(words, word)),
        m AS (SELECT doc_id, label, len(met) AS shared, n FROM win WHERE len(met) >= need AND len(list_intersect(met, telling)) >= need_telling),
        more AS (SELECT doc_id, list(DISTINCT label) AS more, max(shared / n) AS score FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
               coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
    """,
    "op6_decontamination": rf"""
        WITH d AS (SELECT doc_id AS id, {WORDS_SQL.format('text')} AS w FROM documents),
        b AS (SELECT item_id AS id, {WORDS_SQL.format('text')} AS w FROM benchmark),
        ds AS ({seeds_sql('d')}), bs AS ({seeds_sql('b')}),
        line AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.pos - bs.pos AS start FROM ds JOIN bs USING (seed)),
        word AS (SELECT doc_id, item_id, start, d.w AS dw, b.w AS bw, unnest(range(1, len(b.w) + 1)) AS k FROM line JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
        same AS (SELECT doc_id, item_id, start, len(any_value(bw)) AS item_words, count(*) FILTER (WHERE start + k >= 1 AND start + k <= len(dw) AND dw[greatest(start + k, 1)] = bw[k]) AS n_matched FROM word GROUP BY ALL),
        best AS (SELECT * FROM same WHERE n_matched >= 0.8 * item_words QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, start) = 1)
        SELECT doc_id, item_id, CAST(item_words AS BIGINT) AS item_words, n_matched, CAST(start AS BIGINT) AS start, n_matched / item_words AS overlap FROM best
    """,
    "op3_quality_rules": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), win AS (
          SELECT doc_id, unnest(range(1, len(words) - 3)) AS pos, words FROM d WHERE len(words) > 4
        ), grams AS (
          SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2], words[pos + 3], words[pos + 4]) AS n FROM win
        ), rep AS (
          SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM grams, range(0, 5) r(k) WHERE n > 1 GROUP BY doc_id
        ), line AS (
          SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d
        ), l AS (
          SELECT doc_id, source, text, raw, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words,
                 regexp_replace(lower(array_to_string(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), ' ')), '[0-9]', '0', 'g') AS norm
          FROM line
        ), own AS (
          SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM l WHERE words > 0 GROUP BY doc_id
        ), t AS (
          SELECT source, norm, text, min(doc_id) AS id FROM l WHERE words > 0 GROUP BY ALL
        ), often AS (
          SELECT source, norm, min(id) AS first_id FROM t GROUP BY ALL HAVING count(*) > 10
        ), first AS (
          SELECT often.source, often.norm, t.text AS first_text FROM often JOIN t ON often.source IS NOT DISTINCT FROM t.source AND often.norm = t.norm AND often.first_id = t.id
        ), gone AS (
          SELECT l.doc_id, sum(l.words) AS words, count(*) AS lines FROM l JOIN first f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm
          WHERE l.words > 0 AND l.text <> f.first_text GROUP BY l.doc_id
        ), m AS (
          SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(length(array_to_string(d.words, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                 CAST(coalesce(gone.lines, 0) AS BIGINT) AS n_removed_lines, CAST(len(d.words) - coalesce(gone.words, 0) AS BIGINT) AS n_left_words
          FROM d LEFT JOIN own USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
        ), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT *, NOT base_failed AND NOT (n_removed_lines > 0 AND (n_left_words < 10 OR n_left_words < 0.3 * n_words)) AS kept FROM f
    """,
    "op7_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
          SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op10_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS order_key
          FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
          SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
        ), levels(round, level, done) AS (
          SELECT 0, CAST(NULL AS DOUBLE), false
          UNION ALL
          SELECT round + 1, new_level, coalesce(new_level <= level, false)
          FROM (SELECT l.round, l.level,
                  (SELECT CAST(sum(source_size) - sum(CASE WHEN l.level IS NOT NULL AND weight * l.level >= 3 * source_size THEN 3 * source_size ELSE 0 END) AS DOUBLE)
                        / sum(CASE WHEN l.level IS NOT NULL AND weight * l.level >= 3 * source_size THEN 0 ELSE weight END) FROM w) AS new_level
                FROM levels l WHERE NOT l.done)
        ), top AS (SELECT max(level) AS level FROM levels), t AS (
          SELECT source, source_size, CASE WHEN weight * level >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM w, top
        ), c AS (
          SELECT d.doc_id, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key ROWS UNBOUNDED PRECEDING) - d.size AS done
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               size * (whole + CASE WHEN done + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS taken
        FROM c
    """,
}
