"""Queries of the training-data problems over the project's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import copies, emails, linkage, packing, pii, spans, tokens
from graticule.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return emails.new_text(table(spark, d, "emails"))


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    """All candidates with their confidence."""
    return linkage.link_documents(table(spark, d, "list_entries"), table(spark, d, "folder_documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_linked(spark, d).filter(F.col("confidence") >= linkage.CONFIDENCE).select("entry_id", "document_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "extracted_table")).select("keep_id", "dup_id")


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "extracted_table")).select("row_id", "primary_key", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "emails"))


def p5_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return pii.sanitise(table(spark, d, "emails"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts decoded from their ids."""
    return tokens.decode(p8_ids(spark, d))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """How full and how even the containers of each capacity are."""
    return packing.report(p9_packed(spark, d), table(spark, d, "pack_capacity"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(table(spark, d, "documents"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.passages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_linked, p4_found, p4_collapsed, p5_found, p5_sanitised, p8_ids, p8_decoded, p9_packed, p9_report, p10_found, p10_coverage, p10_passages)}

ORACLE: dict[str, str] = {}

_CANON = r"trim(regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
ORACLE["p4_found"] = f"""
WITH c AS (SELECT row_id, coalesce({_CANON.format('primary_key')}, '#null') AS k, list_sort(list_distinct(list_transform(map_entries(cols), lambda e: coalesce({_CANON.format('e.key')}, '#null') || chr(1) || coalesce({_CANON.format('e.value')}, '#null')))) AS v FROM extracted_table),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY k, v) AS keep_id FROM c)
SELECT keep_id, row_id AS dup_id FROM g WHERE row_id <> keep_id
"""

ORACLE["p4_collapsed"] = f"""
WITH c AS (SELECT row_id, primary_key, coalesce({_CANON.format('primary_key')}, '#null') AS k, list_sort(list_distinct(list_transform(map_entries(cols), lambda e: coalesce({_CANON.format('e.key')}, '#null') || chr(1) || coalesce({_CANON.format('e.value')}, '#null')))) AS v FROM extracted_table)
SELECT min(row_id) AS row_id, arg_min(coalesce(primary_key, '#null'), row_id) AS pk, count(*) AS copies FROM c GROUP BY k, v
""".replace("arg_min(coalesce(primary_key, '#null'), row_id) AS pk", "CASE WHEN arg_min(coalesce(primary_key, '#null'), row_id) = '#null' THEN NULL ELSE arg_min(coalesce(primary_key, '#null'), row_id) END AS primary_key")

# every window of 150 characters, kept if it stands in two documents; windows that overlap or touch are one run
_RUNS = """
w AS (SELECT doc_id, i - 1 AS a, md5(substring(text, i, 150)) AS h FROM documents, unnest(range(1, greatest(length(text) - 148, 1))) AS u(i) WHERE length(text) >= 150),
m AS (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 150 THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (h)),
g AS (SELECT doc_id, a, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM s),
r AS (SELECT doc_id, CAST(min(a) AS INT) AS start_pos, CAST(max(a) + 150 AS INT) AS end_pos FROM g GROUP BY doc_id, run)"""
ORACLE["p10_found"] = f"WITH {_RUNS} SELECT doc_id, start_pos, end_pos FROM r"
ORACLE["p10_coverage"] = f"WITH {_RUNS}, c AS (SELECT doc_id, sum(end_pos - start_pos) AS n FROM r GROUP BY 1) SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INT) AS n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(length(d.text), 0) > 0 THEN coalesce(c.n, 0)::DOUBLE / length(d.text) ELSE 0.0 END AS share FROM documents d LEFT JOIN c USING (doc_id)"
ORACLE["p8_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
