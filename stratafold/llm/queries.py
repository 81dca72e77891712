"""The registered queries of this subpackage: op1 to op10, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm import decontamination, licences, main_text, near_dedup, piece_codec, quality_rules, quality_score, secrets, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.train(spark))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents")).drop("rid")


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(_table(spark, sf_dir, "documents"))


def op8_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _op3_sql() -> str:
    """Every place of a text is tried as the begin of every template, and the template's words are compared one by one."""
    rows = [f"({n}, '{label}', {str(base).lower()}, string_split('{text}', ' '), {first}, {last})" for n, label, base, text, first, last in licences.entries()]
    k = licences.K_WORDS
    same = " AND ".join(f"docs.words[place + {j}] = t.words[spot + {j}]" for j in range(1, k + 1))
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '{licences.SPLIT}'), lambda w: w <> '') AS words FROM documents),
        t(template, label, base, words, key_first, key_last) AS (VALUES {', '.join(rows)}),
        heads AS (SELECT DISTINCT words[spot + 1] AS w, template, spot FROM t, (SELECT unnest(range(400)) AS spot) WHERE spot <= len(words) - {k}),
        hits AS (SELECT rid, t.template, spot, place - spot AS diagonal FROM (SELECT rid, words, unnest(range(len(words) - {k - 1})) AS place FROM docs) docs JOIN heads ON heads.w = docs.words[place + 1] JOIN t USING (template) WHERE {same}),
        passages AS (SELECT a.rid, a.template, a.diagonal, list_distinct(list(b.spot)) AS held FROM (SELECT DISTINCT rid, template, diagonal FROM hits) a JOIN hits b ON a.rid = b.rid AND a.template = b.template AND abs(a.diagonal - b.diagonal) <= CASE WHEN a.template < {len(licences.BASE)} THEN 0 ELSE {licences.DRIFT} END GROUP BY ALL),
        judged AS (SELECT rid, label, base, diagonal, len(held) / (len(t.words) - {k - 1}) AS share, base AND len(held) = len(t.words) - {k - 1} AS whole, list_has_all(held, range(key_first, key_last + 1)) AS keyed FROM passages JOIN t USING (template))
        SELECT docs.doc_id, CAST(len(docs.words) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE whole) AS BIGINT) AS n_base, CAST(min(diagonal) FILTER (WHERE whole) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (WHERE whole) AS BIGINT) AS last_word,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole OR NOT base AND share >= {licences.COVERAGE} AND keyed), '') AS labels,
            CAST(coalesce(max(CASE WHEN base AND NOT whole THEN 0 ELSE share END), 0) AS DOUBLE) AS score
        FROM docs LEFT JOIN judged USING (rid) GROUP BY docs.rid, docs.doc_id, docs.words"""


_OP9_SQL = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
    g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
    SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN bytes >= {warc.LEAST} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= {warc.LEAST} AND page_id <> top THEN top END AS refers_to
    FROM p JOIN g USING (html)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others train, segment or sign, and tests hold them against brute force."""
    return {"op3_licence_scan": _op3_sql(), "op9_arc_to_warc": _OP9_SQL}
