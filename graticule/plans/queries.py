"""Queries of the general operators over the test tables, each with the SQL that gives the same rows.

Where the tables hold no relation of an operator's shape, one is derived by column expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions import text as tx
from graticule.operators import docs, reconcile, registry, store, wires
from graticule.sources import scans
from graticule.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- reconciliation

TABLE = ["table_code AS code", "table_description AS description", "source_table AS source", "entry_id AS ord"]
FOLDER = ["folder_code AS code", "folder_description AS description", "document_id"]
NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce({0},''), '^\s+|\s+$', '', 'g')), '[\s\-_]+', '-', 'g'), '-$', ''), '^-', '')"
TOK = r"list_distinct(list_filter(string_split_regex(lower(coalesce({0},'')), '[\s\-_:.,;/\\]+'), lambda x: x <> ''))"
JAC = "CASE WHEN len({0})=0 AND len({1})=0 THEN 1.0::double WHEN len({0})=0 OR len({1})=0 THEN 0.0::double ELSE len(list_intersect({0},{1}))::double/(len({0})+len({1})-len(list_intersect({0},{1}))) END"
RECONCILE = f"""
t0 AS (SELECT {NORM.format('table_code')} AS t_key, entry_id AS ord, table_code AS code, table_description AS description, source_table AS source FROM list_entries),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_key ORDER BY ord) AS rn FROM t0 WHERE t_key <> '') WHERE rn = 1),
f0 AS (SELECT {NORM.format('folder_code')} AS f_key, document_id, folder_code AS f_code, folder_description AS f_description FROM folder_documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f_key ORDER BY document_id DESC) AS rn, min(document_id) OVER (PARTITION BY f_key) AS pos FROM f0 WHERE f_key <> '') WHERE rn = 1),
tt AS (SELECT t_key, {TOK.format('t_key')} AS ta FROM t), ft AS (SELECT f_key, pos, {TOK.format('f_key')} AS tb FROM f),
sc AS (SELECT t_key, f_key, pos, {JAC.format('ta', 'tb')} AS s FROM tt, ft),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_key ORDER BY s DESC, pos) AS rn FROM sc WHERE s >= 0.5) WHERE rn = 1),
l AS (SELECT t.t_key, t.source, best.f_key, best.s, f.document_id, t.description AS d1, f.f_description AS d2, {NORM.format('t.code')} AS c1, {NORM.format('f.f_code')} AS c2, {NORM.format('t.description')} AS n1, {NORM.format('f.f_description')} AS n2 FROM t LEFT JOIN best USING (t_key) LEFT JOIN f ON best.f_key = f.f_key),
e AS (SELECT t_key AS primary_key, CASE WHEN f_key IS NULL THEN 'missing_from_folder' WHEN (c1 = '' OR c2 = '' OR contains(c1, c2) OR contains(c2, c1)) AND (n1 = '' OR n2 = '' OR contains(n1, n2) OR contains(n2, n1)) THEN 'matched' ELSE 'partial' END AS status, round(s, 6) AS score, source, document_id,
 CASE WHEN f_key IS NOT NULL AND coalesce(d1,'') <> '' AND coalesce(d2,'') <> '' THEN round({JAC.format(TOK.format('d1'), TOK.format('d2'))}, 6) END AS description_score,
 CASE WHEN f_key IS NOT NULL AND coalesce(d1,'') <> '' AND coalesce(d2,'') <> '' THEN {JAC.format(TOK.format('d1'), TOK.format('d2'))} >= 0.5 END AS description_match FROM l
 UNION ALL SELECT f_key, 'missing_from_table', NULL, NULL, document_id, NULL, NULL FROM f WHERE f_key NOT IN (SELECT f_key FROM best))
"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(table(spark, d, "list_entries").selectExpr(*TABLE), table(spark, d, "folder_documents").selectExpr(*FOLDER))


@query(f"WITH {RECONCILE} SELECT * FROM e")
def reconcile_entries_report(spark, d):
    """Fuzzy full outer match of the code lists with statuses."""
    return _entries(spark, d)


@query(f"WITH {RECONCILE} SELECT count(*) FILTER (status='matched') AS matched, count(*) FILTER (status='partial') AS partial, count(*) FILTER (status='missing_from_folder') AS missing_from_folder, count(*) FILTER (status='missing_from_table') AS missing_from_table, count(*) FILTER (score=1) AS score_exact, count(*) FILTER (score>=0.9 AND score<1) AS score_high, count(*) FILTER (score>=0.7 AND score<0.9) AS score_medium, count(*) FILTER (score<0.7) AS score_low, count(*) FILTER (description_score=1) AS desc_exact, count(*) FILTER (description_score>=0.9 AND description_score<1) AS desc_high, count(*) FILTER (description_score>=0.5 AND description_score<0.9) AS desc_medium, count(*) FILTER (description_score<0.5) AS desc_low, count(*) FILTER (NOT description_match) AS desc_mismatch FROM e")
def reconcile_summary(spark, d):
    return reconcile.summary(_entries(spark, d))


@query(f"WITH {RECONCILE} SELECT r.source_table AS source, any_value(r.n) AS entries, count(*) FILTER (status='matched') AS matched, count(*) FILTER (status='partial') AS partial, count(*) FILTER (status='missing_from_folder') AS missing_from_folder FROM (SELECT source_table, count(*) AS n FROM list_entries GROUP BY 1) r LEFT JOIN e ON e.source = r.source_table GROUP BY 1")
def reconcile_multi_source(spark, d):
    t = table(spark, d, "list_entries").selectExpr(*TABLE)
    return reconcile.source_stats(t, _entries(spark, d))


@query("SELECT document_id, document_name, max(CASE WHEN field_name='codice' THEN value_text END) AS codice, max(CASE WHEN field_name='titolo' THEN value_text END) AS titolo, max(CASE WHEN field_name='revisione' THEN value_text END) AS revisione FROM document_field_value WHERE field_name IN ('codice','titolo','revisione') GROUP BY 1, 2")
def eav_pivot(spark, d):
    return reconcile.pivot_fields(table(spark, d, "document_field_value"), ["codice", "titolo", "revisione"])


@query("SELECT DISTINCT field_name FROM document_field_value WHERE field_name <> '' ORDER BY 1 LIMIT 100")
def eav_field_list(spark, d):
    return reconcile.field_list(table(spark, d, "document_field_value"))


@query("WITH n AS (SELECT DISTINCT field_name AS field FROM document_field_value WHERE field_name IS NOT NULL) SELECT a.field, b.field AS suggestion FROM n a JOIN n b ON lower(a.field) = lower(b.field) AND a.field <> b.field")
def case_mismatch_fields(spark, d):
    return reconcile.case_twins(table(spark, d, "document_field_value"))


@query("SELECT row_id, source_name, coalesce(cols['Scala'], '') AS scala, coalesce(cols['Formato'], '') AS formato FROM extracted_table")
def extracted_scan(spark, d):
    return reconcile.extracted_values(table(spark, d, "extracted_table"), {"scala": "Scala", "formato": "Formato"})


@query(r"SELECT entry_id, concat_ws('-', CASE WHEN trim(coalesce(table_code,'')) <> '' THEN table_code END, CASE WHEN trim(coalesce(discipline,'')) <> '' THEN discipline END) AS composed FROM list_entries WHERE starts_with(lower(trim(coalesce(table_code,''))), 'gfz')")
def composed_keys(spark, d):
    own = table(spark, d, "list_entries").filter(tx.code_prefix(F.col("table_code"), "GFZ"))
    return own.select("entry_id", tx.compose([F.col("table_code"), F.col("discipline")]).alias("composed"))


# ---- catalogue

@query("SELECT mcp_id, mcp_name, category FROM registry WHERE enabled AND visibility IN ('public','beta')")
def registry_visible(spark, d):
    return registry.visible(table(spark, d, "registry")).select("mcp_id", "mcp_name", "category")


@query("SELECT DISTINCT category FROM registry WHERE enabled AND visibility IN ('public','beta') AND category IS NOT NULL")
def registry_categories(spark, d):
    return registry.visible(table(spark, d, "registry")).select("category").filter("category is not null").distinct()


@query("SELECT mcp_id, mcp_name FROM registry WHERE enabled AND visibility IN ('public','beta') AND (coalesce(regexp_matches(mcp_name, '(?i)cavi|pdf'), false) OR coalesce(regexp_matches(description, '(?i)cavi|pdf'), false) OR coalesce(regexp_matches(author, '(?i)cavi|pdf'), false) OR coalesce(len(list_filter(tags, lambda t: coalesce(regexp_matches(t, '(?i)cavi|pdf'), false))) > 0, false))")
def search_regex(spark, d):
    return registry.search_regex(registry.visible(table(spark, d, "registry")), "cavi|pdf", ["mcp_name", "description", "author"], "tags").select("mcp_id", "mcp_name")


@query("SELECT mcp_id, category FROM registry WHERE coalesce(contains(lower(mcp_name), 'ti'), false) OR coalesce(contains(lower(description), 'ti'), false) OR coalesce(len(list_filter(tags, lambda t: coalesce(contains(lower(t), 'ti'), false))) > 0, false)")
def search_substring(spark, d):
    return registry.search_substring(table(spark, d, "registry"), "ti", ["mcp_name", "description"], "tags").select("mcp_id", "category")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*e') ORDER BY p_partkey LIMIT 20")
def search_limit(spark, d):
    """The report's first twenty hits."""
    return registry.search_regex(table(spark, d, "part"), "^[a-m].*e", ["p_name"]).select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


# a manifest for a third of the rows, each of its parts now given and now missing
MANIFEST = {"container_port": "CASE WHEN port % 2 = 0 THEN port + 1 END", "sse_endpoint": "CASE WHEN port % 5 = 1 THEN '/m' END", "protocol": "CASE WHEN port % 2 = 1 THEN 'http' END", "needs_port_mapping": "CASE WHEN port % 5 = 2 THEN false END", "default_host_port": "CASE WHEN port % 5 = 3 THEN 1 END", "needs_file_access": "CASE WHEN port % 7 = 0 THEN true END"}
_M = ", ".join(f"CASE WHEN port % 3 = 0 THEN {x} END AS m_{n}" for n, x in MANIFEST.items())
_PICK = ", ".join(f"coalesce(m_{n}, docker_defaults.{n}{more}) AS {n}" for n, more in (("container_port", ", port"), ("sse_endpoint", ""), ("protocol", ", 'tcp'"), ("needs_port_mapping", ", coalesce(CASE WHEN port % 12 = 0 THEN 'sse' END, transport, '') = 'sse'"), ("default_host_port", ", port"), ("needs_file_access", ", false")))
_MAP = "list_aggregate(list_sort(list_transform(map_entries({0}), lambda e: e.key || '=' || coalesce(e.value, ''))), 'string_agg', ',')"


@query(f"WITH r AS (SELECT *, {_M}, CASE WHEN port % 15 = 0 THEN {{'memory': '1g', 'cpus': CAST(NULL AS VARCHAR)}} END AS m_resources, CASE WHEN port % 6 = 0 THEN MAP {{'/m': '/n'}} END AS m_mounts FROM registry) SELECT DISTINCT mcp_id, {_PICK}, CASE WHEN m_resources IS NOT NULL THEN m_resources.memory WHEN docker_defaults.resources IS NOT NULL THEN docker_defaults.resources.memory ELSE '512m' END AS memory, CASE WHEN m_resources IS NOT NULL THEN m_resources.cpus WHEN docker_defaults.resources IS NOT NULL THEN docker_defaults.resources.cpus ELSE '0.5' END AS cpus, CASE WHEN m_mounts IS NOT NULL THEN {_MAP.format('m_mounts')} WHEN cardinality(docker_defaults.volume_mounts) > 0 THEN {_MAP.format('docker_defaults.volume_mounts')} WHEN docker_defaults.volume_mounts IS NOT NULL THEN '' END AS mounts FROM r")
def docker_defaults(spark, d):
    """Container settings from the manifest, the stored defaults and the row, in this order."""
    parts = ", ".join(f"'{n}', {x}" for n, x in MANIFEST.items())
    manifest = F.expr(f"CASE WHEN port % 3 = 0 THEN named_struct({parts}, 'volume_mounts', CASE WHEN port % 6 = 0 THEN map('/m', '/n') END, 'resources', CASE WHEN port % 15 = 0 THEN named_struct('memory', '1g', 'cpus', CAST(NULL AS STRING)) END) END")
    r = table(spark, d, "registry").select("mcp_id", registry.docker_defaults(F.col("docker_defaults"), F.col("transport"), F.col("port"), manifest, F.expr("CASE WHEN port % 12 = 0 THEN 'sse' END")).alias("x"))
    mounts = F.array_join(F.array_sort(F.transform(F.map_entries("x.volume_mounts"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ",")
    return r.select("mcp_id", *[f"x.{n}" for n in MANIFEST], "x.resources.memory", "x.resources.cpus", mounts.alias("mounts")).distinct()


DOCS = ["c_custkey AS id", "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name", "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS category", "CAST(NULL AS STRING) AS tag"]
MANIFESTS = ["c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS name", "CASE WHEN c_custkey % 7 = 0 THEN 'manifest' END AS category", "CASE WHEN c_custkey % 4 = 0 THEN 'v1' END AS tag"]


@query(f"WITH a AS (SELECT {', '.join(DOCS).replace('STRING', 'VARCHAR')} FROM customer), b AS (SELECT {', '.join(MANIFESTS)} FROM customer WHERE c_custkey % 6 <> 1) SELECT a.id, coalesce(b.name, a.name, '') AS name, coalesce(b.category, a.category, 'other') AS category, coalesce(b.tag, a.tag, 'latest') AS tag FROM a LEFT JOIN b ON a.id = b.id")
def manifest_merge(spark, d):
    c = table(spark, d, "customer")
    return registry.merge_manifests(c.selectExpr(*DOCS), c.filter("c_custkey % 6 <> 1").selectExpr(*MANIFESTS), "id", {"name": "", "category": "other", "tag": "latest"})


CHANGES = ["s_suppkey + 5 AS s_suppkey", "upper(s_name) AS s_name", "s_nationkey", "CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal"]


@query(f"WITH n AS (SELECT {', '.join(CHANGES)} FROM supplier) SELECT * FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert_new_only(spark, d):
    s = table(spark, d, "supplier")
    return registry.insert_new(s, s.selectExpr(*CHANGES), "s_suppkey")


@query(f"WITH n AS (SELECT {', '.join(CHANGES)} FROM supplier) SELECT s.s_suppkey, coalesce(n.s_name, s.s_name) AS s_name, s.s_nationkey, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_acctbal ELSE s.s_acctbal END AS s_acctbal FROM supplier s LEFT JOIN n USING (s_suppkey)")
def update_set_unset(spark, d):
    s = table(spark, d, "supplier")
    return registry.update(s, s.selectExpr(*CHANGES), "s_suppkey", ["s_name"], ["s_acctbal"])


@query("SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def delete_by_id(spark, d):
    s = table(spark, d, "supplier")
    return registry.delete(s, s.filter("s_acctbal < 0"), "s_suppkey")


@query("SELECT n_regionkey AS category, count(*) AS tools, list_aggregate(list_sort(list(n_name)), 'string_agg', ',') AS names FROM nation WHERE contains(lower(n_name), 'n') GROUP BY 1")
def category_search(spark, d):
    own = table(spark, d, "nation").filter(F.contains(F.lower("n_name"), F.lit("n")))
    return own.groupBy(F.col("n_regionkey").alias("category")).agg(F.count("*").alias("tools"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


# ---- stored results

@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT','BIGINT','DOUBLE') AND CAST(json_extract(props, '$.k') AS DOUBLE) = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY event_id LIMIT 20 OFFSET 5")
def json_filter_range_page(spark, d):
    e = table(spark, d, "events").filter(store.equals(F.col("props"), "k", 7) & store.in_range(F.col("ts"), {"$gte": "2024-01-05", "$lt": "2024-01-20"}))
    return store.page(e.select("event_id", store.navigate(F.col("props"), "k").cast("int").alias("k")), ["event_id"], 5, 20)


@query("SELECT 3 AS page, CAST(greatest(0, least(25, count(*) - 50)) AS BIGINT) AS page_count, count(*) > 75 AS has_more, count(*) AS total_count FROM orders WHERE o_orderstatus = 'F'")
def page_envelope(spark, d):
    return store.envelope(table(spark, d, "orders").filter("o_orderstatus = 'F'"), 50, 25)


@query()
def stored_summaries(spark, d):
    return store.summaries(table(spark, d, "stored_response"), "response_id", "summary")


@query("SELECT response_id, length(summary) AS size_chars, substring(summary, 1, 200) AS head FROM stored_response WHERE length(coalesce(summary, '')) > 500")
def spill_stubs(spark, d):
    return store.spill(table(spark, d, "stored_response"), "response_id", "summary", 500)[1].select("response_id", F.col("size_chars").cast("bigint").alias("size_chars"), "head")


@query("SELECT response_id, ts_ms FROM stored_response WHERE ts_ms >= 1704067200000 - 3600000")
def spill_expiry(spark, d):
    return store.expire(table(spark, d, "stored_response"), "ts_ms", 1_704_067_200_000).select("response_id", "ts_ms")


@query("""SELECT p_partkey, concat('"', replace(replace(p_name, '\\', '\\\\'), '"', '\\"'), '"') || ',' || CASE WHEN p_size IS NULL OR p_size = 0 THEN '""' ELSE CAST(p_size AS VARCHAR) END AS line FROM part""")
def csv_export_cells(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat_ws(",", tx.csv_cell(F.col("p_name"), "string"), tx.csv_cell(F.col("p_size"), "int")).alias("line"))


@query("WITH r AS (SELECT doc_id, source || '.pdf' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN name ELSE replace(name, '.pdf', '(' || CAST(n AS VARCHAR) || ').pdf') END AS unique_name FROM r")
def dup_filename(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("name"))
    return store.unique_names(own, "name", ["doc_id"]).select("doc_id", "unique_name")


# ---- connection records

WIRES = [
    "CAST(l_orderkey AS {s}) AS id", "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord", "100 + l_suppkey % 4 AS sheet",
    "CASE WHEN l_linenumber % 3 = 0 THEN concat('rimando ', CAST(100 + l_partkey % 4 AS {s}), '.', CAST(l_partkey % 9 AS {s})) ELSE concat('QM', CAST(l_partkey % 400 AS {s}), '.', CAST(l_linenumber AS {s})) END AS src",
    "CASE WHEN (l_linenumber + l_suppkey) % 2 = 0 THEN concat('rimando ', CAST(100 + (l_partkey + l_suppkey) % 4 AS {s})) ELSE concat('KM', CAST(l_suppkey AS {s}), '.', CAST(l_partkey % 7 AS {s})) END AS dst",
    "l_returnflag AS cable", "CASE WHEN l_partkey % 3 = 0 THEN '2,5' WHEN l_partkey % 3 = 1 THEN '160.2' WHEN l_partkey % 5 = 1 THEN ' 1.5 MM2' WHEN l_partkey % 5 = 2 THEN '3 x 1.5' WHEN l_partkey % 5 = 3 THEN '70' WHEN l_partkey % 5 = 4 THEN '-1' END AS gauge", "l_linestatus AS color", "CASE WHEN l_quantity > 30 THEN concat('n', CAST(l_linenumber AS {s})) END AS note", "CASE WHEN l_linenumber = 1 THEN -1.0 * l_quantity WHEN l_linenumber = 2 THEN l_quantity * 100000.0 WHEN l_linenumber = 3 AND l_quantity > 25 THEN 0.0 ELSE l_quantity * 7.3 END AS length_mm",
]
WSQL = "w0 AS (SELECT " + ", ".join(x.format(s="VARCHAR") for x in WIRES) + " FROM lineitem)"
UREF = r"CASE WHEN starts_with(lower({0}), 'rimando') THEN regexp_replace({0}, '^(rimando\s+\d+)\.\d+$', '\1') || '@' || CAST(sheet AS VARCHAR) ELSE {0} END"
CLEAN = WSQL + f", w AS (SELECT * REPLACE ({UREF.format('src')} AS src, {UREF.format('dst')} AS dst) FROM w0)"
RESOLVE = CLEAN + r""", ends AS (SELECT id, src AS n FROM w UNION SELECT id, dst FROM w), refs AS (SELECT id, n, regexp_extract(n, 'rimando\s+(-?\d+)@', 1) AS to_s, regexp_extract(n, '@(-?\d+)$', 1) AS on_s FROM ends WHERE starts_with(n, 'rimando')),
re AS (SELECT x.id, x.n AS a, y.n AS b FROM refs x JOIN refs y ON x.id = y.id AND x.to_s = y.on_s AND x.on_s = y.to_s WHERE x.n <> y.n UNION SELECT id, src, dst FROM w WHERE starts_with(src,'rimando') AND starts_with(dst,'rimando') AND src <> dst UNION SELECT id, dst, src FROM w WHERE starts_with(src,'rimando') AND starts_with(dst,'rimando') AND src <> dst),
touch AS (SELECT id, src AS r, dst AS n FROM w WHERE NOT starts_with(src,'rimando') AND starts_with(dst,'rimando') UNION SELECT id, dst, src FROM w WHERE NOT starts_with(dst,'rimando') AND starts_with(src,'rimando')),
reach AS (SELECT id, r, n FROM touch UNION SELECT p.id, p.r, re.b FROM reach p JOIN re ON re.id = p.id AND re.a = p.n),
pairs AS (SELECT id, least(src,dst) AS a, greatest(src,dst) AS b FROM w WHERE NOT starts_with(src,'rimando') AND NOT starts_with(dst,'rimando') AND src <> dst UNION SELECT x.id, x.r, y.r FROM reach x JOIN touch y ON x.id = y.id AND x.n = y.n WHERE x.r < y.r)"""


def _wires(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[x.format(s="STRING") for x in WIRES])


@query(f"WITH RECURSIVE {RESOLVE} SELECT DISTINCT * FROM pairs")
def wire_resolve(spark, d):
    return wires.resolve(wires.complete(_wires(spark, d)))


@query(f"WITH RECURSIVE {RESOLVE} SELECT w.id, w.ord, w.src, w.dst FROM w WHERE (starts_with(src,'rimando') OR starts_with(dst,'rimando')) AND id NOT IN (SELECT id FROM pairs)")
def unresolved_refs(spark, d):
    w = wires.complete(_wires(spark, d))
    return wires.unresolved(w, wires.resolve(w)).select("id", "ord", "src", "dst")


@query(f"WITH RECURSIVE {RESOLVE} SELECT DISTINCT id, a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.id = p.id AND least(src,dst) = p.a AND greatest(src,dst) = p.b)")
def new_connections(spark, d):
    w = wires.complete(_wires(spark, d))
    return wires.new_connections(w, wires.resolve(w))


BASE = r"(CASE WHEN regexp_extract({0}, '^[A-Za-z]+\d+', 0) <> '' THEN regexp_extract({0}, '^[A-Za-z]+\d+', 0) ELSE {0} END)"


@query(f"WITH RECURSIVE {RESOLVE} SELECT DISTINCT {BASE.format('n')} AS node, CASE WHEN n LIKE 'QM%' THEN 'breaker' ELSE 'relay' END AS kind FROM (SELECT a AS n FROM pairs UNION SELECT b FROM pairs)")
def schema_graph_nodes(spark, d):
    return wires.schema_nodes(wires.resolve(wires.complete(_wires(spark, d))))


@query(f"""WITH RECURSIVE {RESOLVE} SELECT DISTINCT '  "' || {BASE.format('a')} || '" -> "' || {BASE.format('b')} || '" [label="' || id || '"];' AS line FROM pairs""")
def dot_lines(spark, d):
    return wires.dot_lines(wires.schema_edges(wires.resolve(wires.complete(_wires(spark, d)))))


@query(f"WITH RECURSIVE {RESOLVE} SELECT DISTINCT {BASE.format('a')} AS source, {BASE.format('b')} AS target, id AS wire_id, count(*) OVER (PARTITION BY id, {BASE.format('a')}, {BASE.format('b')}) AS edges FROM (SELECT DISTINCT * FROM pairs)")
def schema_graph_edges(spark, d):
    e = wires.schema_edges(wires.resolve(wires.complete(_wires(spark, d))))
    return e.groupBy("source", "target", "wire_id").agg(F.count("*").alias("edges"))


GAUGE = r"CASE WHEN contains(lower(trim({0})), 'mm') OR regexp_matches(lower(trim({0})), '^\d+\s*x\s*\d+') THEN trim({0}) WHEN try_cast(replace(lower(trim({0})), ',', '.') AS DOUBLE) > 0 AND try_cast(replace(lower(trim({0})), ',', '.') AS DOUBLE) <= 70 THEN trim({0}) ELSE '' END"
CUTS = f"SELECT coalesce(cable,'') AS cable, {GAUGE.format('gauge')} AS gauge, coalesce(color,'') AS color, CAST(floor(sum(n) + 0.5) AS BIGINT) AS total_mm, count(*) AS pieces FROM v WHERE n <> 0 GROUP BY 1, 2, 3"


@query(f"WITH {WSQL}, v AS (SELECT *, CAST(length_mm AS DOUBLE) AS n FROM w0) {CUTS}")
def cut_list(spark, d):
    """Lengths that are numbers count as they are, whatever their sign and size."""
    return wires.cut_list(_wires(spark, d))


LENGTHS = ["p_brand AS cable", "p_type AS color", "CASE WHEN p_size % 4 = 0 THEN '2,5' WHEN p_size % 4 = 1 THEN '4mm' WHEN p_size % 4 = 2 THEN '99' END AS gauge", "CASE p_partkey % 10 WHEN 0 THEN '2,5' WHEN 1 THEN '1,5,2' WHEN 2 THEN '-3' WHEN 3 THEN '2000000' WHEN 4 THEN ' 12 ' WHEN 5 THEN 'abc' WHEN 6 THEN '' WHEN 7 THEN '0' WHEN 8 THEN CAST(p_size AS {s}) END AS length_mm"]


@query(f"WITH w0 AS (SELECT {', '.join(x.format(s='VARCHAR') for x in LENGTHS)} FROM part), x AS (SELECT *, try_cast(CASE WHEN contains(length_mm, ',') THEN substring(length_mm, 1, strpos(length_mm, ',') - 1) || '.' || substring(length_mm, strpos(length_mm, ',') + 1) ELSE length_mm END AS DOUBLE) AS m FROM w0), v AS (SELECT *, CASE WHEN m > 0 AND m < 1000000 THEN m END AS n FROM x) {CUTS}")
def cut_list_text(spark, d):
    """Lengths that are texts: a decimal comma counts, numbers out of range do not."""
    return wires.cut_list(table(spark, d, "part").selectExpr(*[x.format(s="STRING") for x in LENGTHS]))


PREFIXES = ["QF", "QM", "QS", "KM", "KA", "K", "TS", "PS", "G", "XT", "X", "FS", "FU", "SB", "SA", "S", "HL", "H", "AP", "PLC", "CPU", "M", "MOT", "-km", "qf", "Q", "T", "F", "ABC"]
REFS = "s_suppkey, concat(CASE s_suppkey % 29 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PREFIXES)) + " END, CAST(s_suppkey % 90 AS {s})) AS ref"


@query(f"WITH r AS (SELECT {REFS.format(s='VARCHAR')} FROM supplier), p AS (SELECT *, regexp_replace(upper(regexp_replace(ref, '^-', '')), '\\d+.*', '') AS prefix FROM r) SELECT s_suppkey, ref, CASE WHEN prefix IN ('QF','QM','QS') THEN 'breaker' WHEN prefix IN ('KM','KA','K') THEN 'relay' WHEN prefix IN ('TS','PS','G') THEN 'power' WHEN prefix IN ('XT','X') THEN 'terminal' WHEN prefix IN ('FS','FU') THEN 'fuse' WHEN prefix IN ('SB','SA','S') THEN 'switch' WHEN prefix IN ('HL','H') THEN 'lamp' WHEN prefix IN ('AP','PLC','CPU') THEN 'plc' WHEN prefix IN ('M','MOT') THEN 'motor' ELSE 'other' END AS kind FROM p")
def component_kinds(spark, d):
    """Every prefix of components with its kind."""
    r = table(spark, d, "supplier").selectExpr(*[x.strip() for x in REFS.format(s="STRING").split(", ", 1)])
    return r.withColumn("kind", wires.component_kind(F.col("ref")))


@query(f"WITH {CLEAN} SELECT id, 'A' AS side, src AS endpoint FROM w UNION ALL SELECT id, 'B', dst FROM w")
def label_rows(spark, d):
    return wires.labels(wires.complete(_wires(spark, d)))


FORMS = ["QM102.13", "AP602-EN101:X1.21", "AP601-ID101.X1:21", "XT3.24.1", "-QM102.13", "AP601-OD102.DO-01/X1.11", "QM1.KM838.11", "QM1.24.1", "xt3.24.1", "X1:7", "rimando 105", " KM5:a.b ", ".5", "QF2:3:4", "PLC1.DO-01/4", "-X2.PE"]
ENDPOINTS = "concat(CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FORMS)) + " END, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS {s}) ELSE '' END) AS endpoint"


@query(r"WITH e AS (SELECT DISTINCT " + ENDPOINTS.format(s="VARCHAR") + r""" FROM part), t AS (SELECT endpoint, trim(endpoint) AS t FROM e),
c AS (SELECT *, regexp_matches(t, '^(-?[A-Za-z]+\d+(-[A-Za-z]+\d+)*)[.:/].*?[.:/]X\d+[.:]([\d.]+)$') AS c1, regexp_matches(t, '^(-?[A-Za-z]+\d+(-[A-Za-z]+\d+)*)[:.]X\d+[:.]([\d.]+)$') AS c2, length(regexp_extract(t, '^[^.:]*', 0)) AS i FROM t),
p AS (SELECT *, CASE WHEN i > 0 AND i < length(t) THEN substring(t, i + 2) END AS pin0 FROM c)
SELECT endpoint, CASE WHEN starts_with(lower(endpoint), 'rimando') THEN 'reference' WHEN regexp_matches(endpoint, '(?i)^-?x\d+[.:]|^-?xt\d+[.:]') THEN 'terminal' ELSE 'component' END AS class,
CASE WHEN c1 OR c2 THEN regexp_extract(t, '^-?[A-Za-z]+\d+(-[A-Za-z]+\d+)*', 0) WHEN pin0 IS NOT NULL THEN substring(t, 1, i) ELSE t END AS component,
CASE WHEN c1 OR c2 THEN regexp_extract(t, 'X\d+[.:]([\d.]+)$', 1) WHEN pin0 IS NULL THEN '' WHEN regexp_matches(pin0, '[A-Za-z]') AND regexp_matches(pin0, '[.:/][\d.]+$') THEN regexp_extract(pin0, '[.:/]([\d.]+)$', 1) ELSE pin0 END AS pin FROM p""")
def endpoint_split(spark, d):
    """Component and pin of endpoints in all their forms."""
    e = table(spark, d, "part").selectExpr(ENDPOINTS.format(s="STRING")).distinct()
    c, p = wires.split_endpoint(F.col("endpoint"))
    return e.select("endpoint", wires.endpoint_class(F.col("endpoint")).alias("class"), c.alias("component"), p.alias("pin"))


@query("WITH n AS (SELECT DISTINCT 'XT' || CAST(s_suppkey % 200 AS VARCHAR) AS name, min(s_suppkey) OVER (PARTITION BY s_suppkey % 200) AS ord FROM supplier), x AS (SELECT a.name, b.name AS corrected, row_number() OVER (PARTITION BY a.name ORDER BY b.ord, b.name) AS rn FROM n a JOIN n b ON length(b.name) = length(a.name) + 1 AND substring(b.name, 4) = substring(a.name, 3)) SELECT name, corrected FROM x WHERE rn = 1")
def suffix_correction(spark, d):
    names = table(spark, d, "supplier").select(F.concat(F.lit("XT"), (F.col("s_suppkey") % 200).cast("string")).alias("name"), F.col("s_suppkey").alias("ord"))
    return wires.suffix_corrections(names)


@query(f"WITH {CLEAN}, e AS (SELECT DISTINCT lower(src) AS n FROM w WHERE sheet = 100 AND NOT starts_with(src,'rimando')) SELECT id, ord, src, dst FROM w WHERE lower(src) IN (SELECT n FROM e) OR lower(dst) IN (SELECT n FROM e)")
def panel_filter(spark, d):
    w = wires.complete(_wires(spark, d))
    ends = w.filter("sheet = 100").filter(~wires.is_reference(F.col("src"))).select(F.lower("src").alias("n"))
    return wires.panel_wires(w.select("id", "ord", "src", "dst"), ends)


@query("WITH c AS (SELECT l_partkey AS ref, l_orderkey * 10 + l_linenumber AS ord, l_shipdate, l_quantity, 'w' || CAST(l_suppkey AS VARCHAR) AS w FROM lineitem), f AS (SELECT ref, w, min(ord) AS first_ord FROM c GROUP BY 1, 2) SELECT c.ref, CAST(sum(l_quantity) AS DOUBLE) AS quantity, any_value(g.wires) AS wires FROM c JOIN (SELECT ref, string_agg(w, ',' ORDER BY first_ord, w) AS wires FROM f GROUP BY 1) g ON g.ref = c.ref GROUP BY 1")
def component_merge(spark, d):
    c = table(spark, d, "lineitem").selectExpr("l_partkey AS ref", "l_orderkey * 10 + l_linenumber AS ord", "l_returnflag AS description", "l_quantity AS quantity", "l_linenumber AS page", "array(concat('w', cast(l_suppkey as string))) AS wires")
    c = c.withColumn("ref", F.col("ref").cast("string"))
    return wires.merge_components(c).select(F.col("ref").cast("bigint").alias("ref"), "quantity", "wires")


@query(r"WITH l AS (SELECT doc_id, trim(x) AS raw FROM documents, unnest(string_split_regex(coalesce(text,''), '\r?\n')) AS u(x)) SELECT doc_id, count(*) AS wires FROM l WHERE regexp_matches(raw, '^(\S+)\s+(\S+)\s*(?:->|–|>|-)\s*(\S+)') GROUP BY 1")
def heuristic_lines(spark, d):
    return wires.parse_lines(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("wires"))


@query("WITH g AS (SELECT p_partkey, 600 + p_size * 40 AS width, 400 + p_size * 32 AS height, r, c FROM part, range(2) t1(r), range(2) t2(c)) SELECT p_partkey, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(floor(c*(width/2.0)) - CASE WHEN c > 0 THEN floor(width/2.0*0.06) ELSE 0 END AS INT) AS x, CAST(floor(r*(height/2.0)) - CASE WHEN r > 0 THEN floor(height/2.0*0.06) ELSE 0 END AS INT) AS y FROM g")
def tile_rects(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "600 + p_size * 40 AS width", "400 + p_size * 32 AS height")
    return wires.tile_rects(p).select("p_partkey", "row", "col", "x", "y")


# ---- documents and scans

@query(r"WITH s AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, list_extract(string_split(text, chr(10)), i) AS item FROM documents, unnest(range(1, len(string_split(coalesce(text,''), chr(10))) + 1)) AS u(i)) SELECT doc_id, pos, item FROM s WHERE regexp_replace(coalesce(item, ''), '^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}\x{85}\x{1680}\x{2028}\x{2029}\x{205F}]+', '') <> ''")
def clause_explode_valid(spark, d):
    return docs.exploded(table(spark, d, "documents"), "doc_id", F.split("text", "\n"))


_TRIM = f"trim({{0}}, '{tx.SPACES}')"


@query(f"WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS c, string_split(text, chr(10) || chr(10)) AS s FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, c[i] AS clause FROM t, unnest(range(1, len(c) + 1)) AS u(i)), s AS (SELECT doc_id, CAST(i - 1 AS INT) AS ord, s[i] AS section FROM t, unnest(range(1, len(s) + 1)) AS u(i)), v AS (SELECT * FROM c WHERE {_TRIM.format('clause')} <> ''), h AS (SELECT v.doc_id, v.pos, min(s.ord) AS section_ord FROM v JOIN s ON s.doc_id = v.doc_id AND contains({_TRIM.format('s.section')}, {_TRIM.format('v.clause')}) GROUP BY 1, 2) SELECT v.doc_id, v.pos, v.clause, h.section_ord, h.section_ord IS NOT NULL AS found FROM v LEFT JOIN h USING (doc_id, pos)")
def clause_context(spark, d):
    """Each line of each text with the first part, by blank lines, that contains it."""
    t = table(spark, d, "documents").filter("text is not null")
    clauses = docs.exploded(t, "doc_id", F.split("text", "\n")).withColumnRenamed("item", "clause")
    sections = t.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("ord", "section"))
    return docs.context(clauses, sections, "doc_id")


@query("WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS item FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN o_orderstatus END AS role FROM orders WHERE o_orderkey % 3 <> 0) SELECT a.k, a.item, CASE WHEN trim(coalesce(b.role,'')) <> '' THEN b.role ELSE 'n.d.' END AS role FROM a LEFT JOIN b USING (k)")
def clause_zip_default(spark, d):
    o = table(spark, d, "orders")
    b = o.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN o_orderstatus END AS role")
    return docs.zipped(o.selectExpr("o_orderkey AS k", "o_orderpriority AS item"), b, ["k"], "role", "n.d.").select("k", "item", "role")


@query("WITH a AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END AS s, o_custkey % 3 <> 0 AS keep, CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE o_orderpriority END AS t FROM orders) SELECT o_orderkey, CASE WHEN s IS NULL THEN 'errore' WHEN NOT keep THEN 'scarta' WHEN trim(coalesce(t,'')) = '' THEN 'popola' ELSE 'modifica' END AS decision FROM a")
def decision_machine(spark, d):
    a = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END AS s", "o_custkey % 3 <> 0 AS keep", "CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE o_orderpriority END AS t")
    return a.select("o_orderkey", docs.decision(F.col("s"), F.col("keep"), F.col("t")).alias("decision"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-06-30' - 30 AND o_orderstatus = 'O'")
def lookback(spark, d):
    return scans.lookback(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "o_orderdate", "1998-06-30").select("o_orderkey", "o_orderdate")


@query("(SELECT 'customer' AS type, c_custkey AS id, c_name AS label FROM customer WHERE contains(lower(c_name), '7') ORDER BY 2 LIMIT 10) UNION ALL (SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '7') ORDER BY 2 LIMIT 10)")
def multi_search(spark, d):
    """Ten hits per entity, as the combined search reports."""
    return scans.tagged_search([("customer", table(spark, d, "customer"), "c_custkey", "c_name"), ("supplier", table(spark, d, "supplier"), "s_suppkey", "s_name")], "7")


@query("SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers")
def category_counts(spark, d):
    n = lambda t, a: table(spark, d, t).agg(F.count("*").alias(a))
    return n("part", "parts").crossJoin(n("customer", "customers")).crossJoin(n("supplier", "suppliers"))


@query("SELECT DISTINCT msg_id, subject FROM emails WHERE list_contains(string_split(coalesce(label,''), ','), 'INBOX') AND (coalesce(contains(lower(subject), 'ticket'), false) OR coalesce(contains(lower(body), 'ticket'), false))")
def mail_search(spark, d):
    return scans.mailbox(table(spark, d, "emails"), "INBOX", "Ticket").select("msg_id", "subject").distinct()


@query("SELECT DISTINCT msg_id, regexp_replace(body, '<[^>]+>', '', 'g') AS body FROM emails")
def mail_plain(spark, d):
    return table(spark, d, "emails").select("msg_id", docs.plain_body(F.col("body")).alias("body")).distinct()


QUERY_VECTOR = [(-1.0) ** i / (i + 1) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5")
def nearest_vectors(spark, d):
    """The five vectors most like a fixed one, a top-k report."""
    return scans.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", QUERY_VECTOR)


@query("SELECT document_id, document_name FROM folder_documents WHERE lower(regexp_extract(document_name, '\\.([^.]+)$', 1)) IN ('pdf')")
def files_by_ending(spark, d):
    return scans.sent_files(table(spark, d, "folder_documents"), ("pdf",), "document_name").select("document_id", "document_name")
