"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"), spark)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(_read(spark, sf_dir, "documents"))


def op4_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .avi import features, store

    return features(store(_read(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import label_quality, mix

    return mix(_read(spark, sf_dir, "documents"), label_quality(_read(spark, sf_dir, "labels")))


def op7_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .logbilinear import score

    return score(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"))


def op9_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_ppm import identify, train

    documents = _read(spark, sf_dir, "documents")
    return identify(documents, train(documents))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_avi_media": op4_avi_media,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_logbilinear": op7_logbilinear,
    "op8_token_counts": op8_token_counts,
    "op9_language_ppm": op9_language_ppm,
    "op10_near_duplicates": op10_near_duplicates,
}

#: Words as in the contracts: runs of characters other than space and U+0009 to U+000D.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

MIX_SQL = """
WITH RECURSIVE d0 AS (SELECT doc_id, source, {size} AS size, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM {docs}),
q AS (SELECT doc_id, max(1.0::DOUBLE + coalesce(quality, 0)) AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d0.*, -ln((('0x' || substr(md5('7:' || d0.name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(q.weight, 1.0) AS key
      FROM d0 LEFT JOIN q ON d0.doc_id = q.doc_id),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w
       FROM d GROUP BY source),
s1 AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS every FROM s0),
s2 AS (SELECT *, (every - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS fill FROM s2),
s4 AS (SELECT source, source_size, least(cap, coalesce(fill * w, cap)) AS target FROM s3),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s4),
r AS (SELECT d.*, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ASC NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
"""

OP6_SQL = (
    MIX_SQL.format(size=_SIZE, docs="documents")
    + "SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"
)

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                     ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM {docs} UNION SELECT r.doc_id, s.b FROM reach r JOIN sym s ON r.other = s.a),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
"""

OP10_SQL = (
    NEAR_SQL.format(docs="documents", percent=85)
    + "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)"
)

OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i:
        list_aggregate(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(sha, 5 * i + 1, 5))::BIGINT >> k) & 31)::INT + 1, 1)), 'string_agg', '')), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

ORACLE: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op6_mixing": OP6_SQL,
    "op10_near_duplicates": OP10_SQL,
}
