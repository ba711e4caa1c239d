"""Queries of the general data problems (2, 6 and 7) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.operators import compare, nested, widen
from graticule.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    typed = nested.flatten_columns(table(spark, d, "registry"), "mcp_id", ["tags", "docker_defaults"])
    texts = nested.flatten_json(table(spark, d, "stored_response"), "response_id", "summary")
    return typed.select("record_id", "parent_path", "child_path").union(texts.select("record_id", "parent_path", "child_path")).distinct()


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """All child rows with their surrogate keys, ordinals and content."""
    typed = nested.flatten_columns(table(spark, d, "registry"), "mcp_id", ["tags", "docker_defaults"])
    return typed.unionByName(nested.flatten_json(table(spark, d, "stored_response"), "response_id", "summary")).distinct()


def p2_tags(spark: SparkSession, d: str) -> DataFrame:
    """One related table: the tags of the registry with their parent's key and place."""
    flat = nested.flatten_columns(table(spark, d, "registry"), "mcp_id", ["tags"])
    return flat.select("record_id", "parent_key", "row_key", "ordinal", F.col("content").alias("tag")).distinct()


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """One related table: the objects of the list ``firstItems`` in typed columns, with their parent's key and place."""
    flat = nested.flatten_json(table(spark, d, "stored_response"), "response_id", "summary")
    items = nested.child_table(flat.distinct(), "firstItems")
    return items.select("record_id", "parent_key", "row_key", "ordinal", *[F.col(c).cast("string").alias(c) for c in ("id", "stato") if c in items.columns])


def _catalog(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return [tuple(r) for r in table(spark, d, "field_catalog").select("field_name", "value_type").collect()]


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return widen.widen(table(spark, d, "document_field_value"), _catalog(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.cells_of(p6_wide(spark, d), _catalog(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare(table(spark, d, "reconcile_entries"), table(spark, d, "reconcile_entries_copy"))


QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p2_tags, p2_rows, p6_found, p6_wide, p7_found)}
ORACLE: dict[str, str] = {}

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_key ORDER BY updated_at DESC, status DESC, match_score DESC) AS rn FROM {0}) WHERE rn = 1"
_SIMPLE = ("status", "match_score", "source_table", "document_id", "document_name")
_DIFFER = {c: f"a.{c} IS DISTINCT FROM b.{c}" for c in _SIMPLE} | {"match_score": "(a.match_score IS NULL) <> (b.match_score IS NULL) OR abs(a.match_score - b.match_score) >= 1e-9"}
_MEMBERS = {m: f"a.v.{m} IS DISTINCT FROM b.v.{m}" for m in ("table_value", "folder_value", "matched")} | {"similarity": "(a.v.similarity IS NULL) <> (b.v.similarity IS NULL) OR abs(a.v.similarity - b.v.similarity) >= 1e-9"}
ORACLE["p7_found"] = f"""
WITH a AS ({_LATEST.format('reconcile_entries')}), b AS ({_LATEST.format('reconcile_entries_copy')}),
am AS (SELECT primary_key, e.key AS k, e.value AS v FROM a, unnest(map_entries(field_results)) AS u(e)), bm AS (SELECT primary_key, e.key AS k, e.value AS v FROM b, unnest(map_entries(field_results)) AS u(e))
SELECT primary_key, 'missing_in_copy' AS diff_kind, '' AS field_name FROM a WHERE primary_key NOT IN (SELECT primary_key FROM b)
UNION ALL SELECT primary_key, 'missing_in_entries', '' FROM b WHERE primary_key NOT IN (SELECT primary_key FROM a)
{' '.join(f"UNION ALL SELECT a.primary_key, 'differs', '{c}' FROM a JOIN b USING (primary_key) WHERE {x}" for c, x in _DIFFER.items())}
UNION ALL SELECT am.primary_key, 'differs', am.k FROM am WHERE primary_key IN (SELECT primary_key FROM b) AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.primary_key = am.primary_key AND bm.k = am.k)
UNION ALL SELECT bm.primary_key, 'differs', bm.k FROM bm WHERE primary_key IN (SELECT primary_key FROM a) AND NOT EXISTS (SELECT 1 FROM am WHERE bm.primary_key = am.primary_key AND bm.k = am.k)
{' '.join(f"UNION ALL SELECT a.primary_key, 'differs', a.k || '.{m}' FROM am a JOIN bm b ON a.primary_key = b.primary_key AND a.k = b.k WHERE {x}" for m, x in _MEMBERS.items())}
"""

_NUMBER = r"regexp_replace(regexp_replace(regexp_replace(t, '(?i)^(?:€|eur)[\s\x{A0}\x{202F}\x{2009}]*', ''), '(?i)[\s\x{A0}\x{202F}\x{2009}]*(?:€|eur|kg)\.?$', ''), '[\s\x{A0}\x{202F}\x{2009}’'']', '''', 'g')"
_MONTHS = "['gen','feb','mar','apr','mag','giu','lug','ago','set','ott','nov','dic']"
_ENGLISH = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_MONTH = f"coalesce(nullif(list_position({_MONTHS}, {{0}}), 0), nullif(list_position({_ENGLISH}, {{0}}), 0))"
_DATE = rf"""try_cast(CASE
 WHEN regexp_matches(l, '^\d{{4}}-\d\d?-\d\d?(t.*)?$') THEN regexp_extract(l, '^\d{{4}}-\d\d?-\d\d?', 0)
 WHEN regexp_matches(l, '^\d\d?[-/.]\d\d?[-/.]\d{{4}}$') THEN regexp_replace(l, '^(\d+).(\d+).(\d+)$', '\3-\2-\1')
 WHEN regexp_matches(l, '^\d\d?[-/.]\d\d?[-/.]\d\d$') THEN regexp_replace(l, '^(\d+).(\d+).(\d+)$', '20\3-\2-\1')
 WHEN regexp_matches(l, '^\d{{8}}$') THEN regexp_replace(l, '^(\d{{4}})(\d\d)(\d\d)$', '\1-\2-\3')
 WHEN regexp_matches(l, '^\d\d?°?\s+[a-z]+\s+\d{{4}}$') THEN regexp_extract(l, '(\d{{4}})$', 1) || '-' || {_MONTH.format("regexp_extract(l, '([a-z]{3})', 1)")} || '-' || regexp_extract(l, '^(\d+)', 1)
 WHEN regexp_matches(l, '^[a-z]+\s+\d\d?,?\s+\d{{4}}$') THEN regexp_extract(l, '(\d{{4}})$', 1) || '-' || {_MONTH.format("regexp_extract(l, '^([a-z]{3})', 1)")} || '-' || regexp_extract(l, '\s(\d+)', 1) END AS date)"""
ORACLE["p6_found"] = rf"""
WITH c AS (SELECT field_name, value_type, replace(field_name, '_', '') AS k FROM field_catalog),
r AS (SELECT document_id, c.field_name, c.value_type, max((loaded_at, value_text)) AS m FROM document_field_value d JOIN c ON regexp_replace(lower(d.field_name), '[^\p{{L}}\p{{N}}]+', '', 'g') = c.k GROUP BY 1, 2, 3),
t AS (SELECT document_id, field_name, value_type, regexp_replace(m[2], '^[\s\x{{A0}}\x{{FEFF}}]+|[\s\x{{A0}}\x{{FEFF}}]+$', '', 'g') AS t FROM r),
v AS (SELECT *, lower(t) AS l, {_NUMBER} AS n FROM t WHERE t <> '' AND lower(t) NOT IN ('-','--','n.d.','nd','n/a','na','null','none')),
o AS (SELECT document_id, field_name, CASE value_type
 WHEN 'text' THEN t
 WHEN 'int' THEN CASE WHEN regexp_matches(t, '^[+-]?\d{{1,18}}([.,]0{{1,2}})?$') THEN CAST(CAST(regexp_replace(t, '[.,]0+$', '') AS BIGINT) AS VARCHAR) END
 WHEN 'bool' THEN CASE WHEN l IN ('true','t','yes','y','si','sì','s','1','vero','v') THEN 'true' WHEN l IN ('false','f','no','n','0','falso') THEN 'false' END
 WHEN 'date' THEN strftime({_DATE}, '%Y-%m-%d')
 WHEN 'decimal' THEN CAST(round(try_cast(CASE WHEN regexp_matches(n, '^[+-]?\d{{1,3}}(\.\d{{3}})+(,\d+)?$') THEN replace(replace(n, '.', ''), ',', '.') WHEN regexp_matches(n, '^[+-]?\d{{1,3}}(,\d{{3}})+(\.\d+)?$') THEN replace(n, ',', '') WHEN regexp_matches(n, '^[+-]?\d{{1,3}}(''\d{{3}})+([.,]\d+)?$|^[+-]?\d+([.,]\d+)?$') THEN replace(replace(n, '''', ''), ',', '.') END AS DECIMAL(30, 8)), 2)::DECIMAL(28, 2) AS VARCHAR) END AS typed_value FROM v)
SELECT document_id, field_name, typed_value FROM o WHERE typed_value IS NOT NULL
"""

# The columns of field_catalog, which is the same at every scale.
_COLUMNS = {'codice': 'text', 'titolo': 'text', 'disciplina': 'text', 'scala': 'text', 'redattore': 'text', 'note': 'text', 'revisione': 'int', 'pagine': 'int', 'importo': 'decimal', 'peso_kg': 'decimal', 'data_emissione': 'date', 'data_scadenza': 'date', 'approvato': 'bool', 'riservato': 'bool'}
_SQL_TYPES = {"text": "VARCHAR", "int": "BIGINT", "decimal": "DECIMAL(28,2)", "date": "DATE", "bool": "BOOLEAN"}
ORACLE["p6_wide"] = ORACLE["p6_found"].rstrip().removesuffix("SELECT document_id, field_name, typed_value FROM o WHERE typed_value IS NOT NULL") + ", e AS (SELECT DISTINCT document_id FROM document_field_value) SELECT e.document_id, " + ", ".join(f"max(CASE WHEN o.field_name = '{n}' THEN CAST(typed_value AS {_SQL_TYPES[t]}) END) AS {n}" for n, t in _COLUMNS.items()) + " FROM e LEFT JOIN o ON o.document_id IS NOT DISTINCT FROM e.document_id GROUP BY e.document_id"

_KEY = "substring(sha256(mcp_id || chr(1) || {0}), 1, 32)"
ORACLE["p2_tags"] = f"SELECT DISTINCT mcp_id AS record_id, {_KEY.format(repr(''))} AS parent_key, {_KEY.format("'tags[' || CAST(i - 1 AS VARCHAR) || ']'")} AS row_key, CAST(i - 1 AS INT) AS ordinal, tags[i] AS tag FROM registry, unnest(range(1, len(tags) + 1)) AS u(i) WHERE tags[i] IS NOT NULL"
