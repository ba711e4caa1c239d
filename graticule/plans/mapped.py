"""Queries of the reconciliation by field mappings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.operators import mapping as mp
from graticule.plans.queries import JAC, NORM, TOK
from graticule.session import table

MAPPINGS = (mp.Mapping("descrizione"), mp.Mapping("codice", True), mp.Mapping("Disciplina"), mp.Mapping("assente"))
FOLDER = (mp.Field("codice", ("folder_code",)), mp.Field("descrizione", ("folder_description",)), mp.Field("disciplina", ("discipline",)))
FIRST = (mp.Field("codice", ("table_code",)), mp.Field("descrizione", ("table_description",)), mp.Field("disciplina", ("discipline",)))
OTHER = (mp.Field("codice", ("table_code",)), mp.Field("descrizione", ("table_description", "author"), " / "), mp.Field("disciplina", ("discipline",)))


def _sides(spark: SparkSession, d: str) -> tuple[list[mp.Source], DataFrame]:
    rows = table(spark, d, "list_entries")
    ryo = F.contains(F.lower(F.coalesce("source_table", F.lit(""))), F.lit("ryo"))
    return [mp.Source("ryo", rows.filter(ryo), OTHER, "entry_id"), mp.Source("rest", rows.filter(~ryo), FIRST, "entry_id"), mp.Source("none", rows.filter(F.lit(False)), FIRST, "entry_id")], table(spark, d, "folder_documents")


def mapped_fields(spark: SparkSession, d: str) -> DataFrame:
    """Two tables with different columns against the folder, field by field."""
    sources, folder = _sides(spark, d)
    return mp.flat_results(mp.compare(sources, folder, FOLDER, MAPPINGS))


def mapped_prefix_summary(spark: SparkSession, d: str) -> DataFrame:
    """Entries by table and status, of codes with one prefix only."""
    sources, folder = _sides(spark, d)
    return mp.compare(sources, folder, FOLDER, MAPPINGS, prefix=" gfz").groupBy("source_table", "status").agg(F.count("*").alias("entries"))


def mapped_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    sources, folder = _sides(spark, d)
    return mp.diagnostics(sources, folder, FOLDER, MAPPINGS, prefix="GFZ")


QUERIES = {f.__name__: f for f in (mapped_fields, mapped_prefix_summary, mapped_diagnostics)}

_RYO = "contains(lower(coalesce(source_table,'')), 'ryo')"
_JOIN = "concat_ws(' / ', CASE WHEN trim(coalesce(table_description,'')) <> '' THEN table_description END, CASE WHEN trim(coalesce(author,'')) <> '' THEN author END)"
_MATCH = "(n1 = '' OR n2 = '' OR contains(n1, n2) OR contains(n2, n1))"


def _sql(prefix: str = "") -> str:
    valid = f"starts_with(lower(trim(c)), '{prefix}')" if prefix else "trim(c) <> ''"
    pairs = "\nUNION ALL ".join(f"SELECT primary_key, f_key, t_key, s, source_table, document_id, '{m}' AS field_name, {a} AS v1, {b} AS v2 FROM e" for m, a, b in (("descrizione", "t_d", "f_d"), ("codice", "t_c", "f_c"), ("Disciplina", "t_p", "f_p"), ("assente", "CASE WHEN t_key IS NOT NULL THEN '' END", "CASE WHEN f_key IS NOT NULL THEN '' END")))
    return f"""
t0 AS (SELECT coalesce(table_code,'') AS c, CASE WHEN {_RYO} THEN {_JOIN} ELSE coalesce(table_description,'') END AS d, coalesce(discipline,'') AS p, CASE WHEN {_RYO} THEN 0 ELSE 1 END AS src, entry_id FROM list_entries),
t AS (SELECT * FROM (SELECT *, {NORM.format('c')} AS t_key, row_number() OVER (PARTITION BY {NORM.format('c')} ORDER BY src, entry_id) AS rn FROM t0 WHERE {valid}) WHERE rn = 1 AND t_key <> ''),
f0 AS (SELECT {NORM.format('folder_code')} AS f_key, document_id, coalesce(folder_code,'') AS c, coalesce(folder_description,'') AS d, coalesce(discipline,'') AS p FROM folder_documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f_key ORDER BY document_id DESC) AS rn, min(document_id) OVER (PARTITION BY f_key) AS pos FROM f0 WHERE f_key <> '') WHERE rn = 1),
tt AS (SELECT t_key, {TOK.format('t_key')} AS ta FROM t), ft AS (SELECT f_key, pos, {TOK.format('f_key')} AS tb FROM f),
sc AS (SELECT t_key, f_key, pos, {JAC.format('ta', 'tb')} AS s FROM tt, ft),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_key ORDER BY s DESC, pos) AS rn FROM sc WHERE s >= 0.5) WHERE rn = 1),
e AS (SELECT t.t_key AS primary_key, best.f_key, t.t_key, best.s, CASE WHEN src = 0 THEN 'ryo' ELSE 'rest' END AS source_table, f.document_id, t.c AS t_c, t.d AS t_d, t.p AS t_p, f.c AS f_c, f.d AS f_d, f.p AS f_p FROM t LEFT JOIN best USING (t_key) LEFT JOIN f ON f.f_key = best.f_key
 UNION ALL SELECT f_key, f_key, NULL, NULL, NULL, document_id, NULL, NULL, NULL, c, d, p FROM f WHERE f_key NOT IN (SELECT f_key FROM best)),
x AS ({pairs}),
y AS (SELECT *, {NORM.format('v1')} AS n1, {NORM.format('v2')} AS n2 FROM x),
z AS (SELECT *, t_key IS NOT NULL AND f_key IS NOT NULL AND {_MATCH} AS matched, CASE WHEN coalesce(v1,'') <> '' AND coalesce(v2,'') <> '' THEN {JAC.format(TOK.format('v1'), TOK.format('v2'))} ELSE 0.0 END AS similarity FROM y),
st AS (SELECT primary_key AS k, t_key AS tk, CASE WHEN any_value(f_key) IS NULL THEN 'missing_from_folder' WHEN t_key IS NULL THEN 'missing_from_table' WHEN bool_and(matched) THEN 'matched' ELSE 'partial' END AS status FROM z GROUP BY 1, 2)"""


ORACLE = {
    "mapped_fields": f"WITH {_sql()} SELECT primary_key, status, source_table, document_id, round(s, 6) AS match_score, field_name, coalesce(v1,'') AS table_value, coalesce(v2,'') AS folder_value, matched, round(similarity, 6) AS similarity FROM z JOIN st ON st.k = z.primary_key AND st.tk IS NOT DISTINCT FROM z.t_key",
    "mapped_prefix_summary": f"WITH {_sql('gfz')} SELECT source_table, status, count(*) AS entries FROM z JOIN st ON st.k = z.primary_key AND st.tk IS NOT DISTINCT FROM z.t_key WHERE field_name = 'codice' GROUP BY 1, 2",
    "mapped_diagnostics": f"SELECT CASE WHEN {_RYO} THEN 'ryo' ELSE 'rest' END AS side, count(*) AS total, count(*) FILTER (NOT starts_with(lower(trim(coalesce(table_code,''))), 'gfz')) AS filtered, bool_and(trim(coalesce(table_code,'') || coalesce(table_description,'') || coalesce(discipline,'') || CASE WHEN {_RYO} THEN coalesce(author,'') ELSE '' END) = '') AS empty FROM list_entries GROUP BY 1 UNION ALL SELECT 'none', 0, 0, true UNION ALL SELECT 'folder', count(*), 0, bool_and(trim(coalesce(folder_code,'') || coalesce(folder_description,'') || coalesce(discipline,'')) = '') FROM folder_documents",
}
