"""Queries of wire reports, catalogue, stored results, mail and scans, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions import text as tx
from graticule.operators import docs, registry, store, wires
from graticule.plans.queries import CLEAN, FORMS, WIRES, WSQL, _wires
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


# ---- wires

REPEATS = ["CAST(l_orderkey AS {s}) AS id", "concat('QM', CAST(l_linenumber % 3 AS {s})) AS src", "'KM1' AS dst", "l_orderkey * 100000 + l_partkey AS ord", "CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS cable", "CASE WHEN l_partkey % 3 = 0 THEN ' ' WHEN l_partkey % 3 = 1 THEN '2,5' END AS gauge", "CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END AS color", "CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS DOUBLE) END AS length_mm", "CASE WHEN l_partkey % 5 = 0 THEN 't' END AS terminal_a", "CASE WHEN l_suppkey % 5 = 0 THEN l_returnflag END AS terminal_b", "CASE WHEN l_partkey % 97 = 0 THEN CAST(l_suppkey AS {s}) WHEN l_partkey % 89 = 0 THEN ' ' END AS note", "l_suppkey % 7 AS page"]
_F = ("cable", "gauge", "color", "terminal_a", "terminal_b")
_SORTED = "ord, sc, note, " + ", ".join(f"{c} NULLS FIRST" for c in ("cable", "gauge", "color", "length_mm", "terminal_a", "terminal_b", "page"))
_TAKE = ", ".join(f"CASE WHEN r.sc + (trim(r.note) <> '')::int > s.sc + (trim(s.note) <> '')::int THEN r.{c} ELSE s.{c} END" for c in ("sc", "cable", "gauge", "color", "length_mm", "terminal_a", "terminal_b", "page"))


@query(f"""WITH RECURSIVE w AS (SELECT {', '.join(x.format(s='VARCHAR') for x in REPEATS)} FROM lineitem),
c AS (SELECT * REPLACE (coalesce(note, '') AS note), {' + '.join(f"(trim(coalesce({x},'')) <> '')::int" for x in _F)} + (length_mm IS NOT NULL)::int AS sc FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY id, src, dst ORDER BY {_SORTED}) AS rn FROM c),
s AS (SELECT id, src, dst, ord, note, sc, cable, gauge, color, length_mm, terminal_a, terminal_b, page, rn FROM r WHERE rn = 1
UNION ALL SELECT s.id, s.src, s.dst, s.ord, CASE WHEN s.note <> '' AND r.note <> '' THEN s.note || ' | ' || r.note ELSE s.note || r.note END, {_TAKE}, r.rn FROM s JOIN r ON r.id = s.id AND r.src = s.src AND r.dst = s.dst AND r.rn = s.rn + 1)
SELECT id, src, dst, ord, note, cable, gauge, color, length_mm, terminal_a, terminal_b, page FROM (SELECT *, max(rn) OVER (PARTITION BY id, src, dst) AS last FROM s) WHERE rn = last""")
def dedup_fold(spark, d):
    """Ordered merge of the wires of equal ends: the better filled row wins, notes are joined."""
    return wires.merge_duplicates(table(spark, d, "lineitem").selectExpr(*[x.format(s="STRING") for x in REPEATS]))


_BASE = r"(CASE WHEN regexp_matches(regexp_replace({0}, '^-', ''), '^[A-Za-z]+\d+') THEN regexp_extract(regexp_replace({0}, '^-', ''), '^[A-Za-z]+\d+', 0) ELSE trim(regexp_replace({0}, '^-', '')) END)"
_KIND = r"(CASE WHEN {0} LIKE 'QM%' THEN 'breaker' WHEN {0} LIKE 'KM%' THEN 'relay' ELSE 'other' END)"
_COLOR = "CASE kind WHEN 'breaker' THEN '#90EE90' WHEN 'relay' THEN '#87CEEB' ELSE '#FFFFFF' END"
# components of a part each; the last description by order that isn't empty
PARTS = ["concat(CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '' END, 'QM', CAST(p_partkey % 400 AS {s}), CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END) AS ref", "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN concat(p_name, ' \"x\"') WHEN p_size % 4 = 2 THEN p_name END AS description", "p_partkey AS ord"]
_NODES = f"""{CLEAN}, p AS (SELECT *, sheet AS page FROM w), e AS (SELECT {_BASE.format('src')} AS node, page, ord, 0 AS side FROM p UNION ALL SELECT {_BASE.format('dst')}, page, ord, 1 FROM p),
n0 AS (SELECT node, arg_min(page, (ord, side)) AS page FROM e GROUP BY 1), c AS (SELECT {', '.join(x.format(s='VARCHAR') for x in PARTS)} FROM part),
d AS (SELECT {_BASE.format('ref')} AS node, arg_max(description, ord) AS d FROM c WHERE ref <> '' AND description <> '' GROUP BY 1),
n1 AS (SELECT node, {_KIND.format('node')} AS kind, page, CASE WHEN d IS NULL THEN node ELSE node || '\\n' || substring(d, 1, 30) END AS label FROM n0 LEFT JOIN d USING (node)),
n AS (SELECT *, {_COLOR} AS color FROM n1)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    w = wires.complete(_wires(spark, d)).withColumn("page", F.col("sheet"))
    return wires.graph_nodes(w, table(spark, d, "part").selectExpr(*[x.format(s="STRING") for x in PARTS]))


@query(f"WITH {_NODES} SELECT * FROM n")
def graph_nodes(spark, d):
    """Components with the page that names them first, their kinds, colours and last descriptions."""
    return _nodes(spark, d)


@query(f"""WITH {_NODES} SELECT '  "' || node || '" [label="' || replace(label, '"', '\\"') || '", fillcolor="' || color || '"];' AS line FROM n""")
def dot_node_lines(spark, d):
    return wires.dot_node_lines(_nodes(spark, d))


@query(f"""WITH {_NODES}, j AS (SELECT {_BASE.format('src')} AS a, {_BASE.format('dst')} AS b, id FROM w) SELECT 'node' AS part, '{{"id":"' || node || '","type":"' || kind || '","label":"' || replace(replace(label, '\\n', '\n'), '"', '\\"').replace(chr(10), '\\n') || '","color":"' || color || '"}}' AS json FROM n UNION ALL SELECT 'edge', '{{"source":"' || a || '","target":"' || b || '","wireId":"' || id || '","label":"Filo ' || id || '"}}' FROM j""")
def graph_json(spark, d):
    return wires.graph_json(_nodes(spark, d), wires.schema_edges(wires.complete(_wires(spark, d)).selectExpr("id", "src AS a", "dst AS b")))


ENDS = ["CAST(p_partkey AS {s}) AS id", "CASE p_partkey % 17 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FORMS)) + " END AS src", "CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 < 3 THEN concat('KM', CAST(p_size AS {s}), '.', CAST(p_partkey % 7 AS {s})) END AS dst", "CASE WHEN p_size % 3 = 0 THEN p_brand END AS cable", "CASE WHEN p_size % 7 = 0 THEN 12.5 END AS length_mm", "p_size AS page", "CASE WHEN p_size % 2 = 0 THEN p_type END AS note"]
_CARD = r"regexp_matches(trim({0}), '^(-?[A-Za-z]+\d+(-[A-Za-z]+\d+)*)([.:/].*?[.:/]|[:.])X\d+[.:]([\d.]+)$')"
_HEAD = r"regexp_extract(trim({0}), '^([^.:]+)[.:]', 1)"
_REST = r"substring(trim({0}), length(" + _HEAD + ") + 2)"
COMPONENT = f"(CASE WHEN {_CARD} THEN regexp_extract(trim({{0}}), '^-?[A-Za-z]+\\d+(-[A-Za-z]+\\d+)*', 0) WHEN {_HEAD} <> '' THEN {_HEAD} ELSE trim({{0}}) END)"
PIN = f"(CASE WHEN {_CARD} THEN regexp_extract(trim({{0}}), 'X\\d+[.:]([\\d.]+)$', 1) WHEN {_HEAD} = '' THEN '' WHEN regexp_matches({_REST}, '[A-Za-z]') AND regexp_matches({_REST}, '[.:/][\\d.]+$') THEN regexp_extract({_REST}, '[.:/]([\\d.]+)$', 1) ELSE {_REST} END)"
_ENDS = f"p0 AS (SELECT {', '.join(x.format(s='VARCHAR') for x in ENDS)} FROM part), p AS (SELECT * REPLACE (coalesce(src, '') AS src, coalesce(dst, '') AS dst) FROM p0)"


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*[x.format(s="STRING") for x in ENDS])


@query(f"WITH {_ENDS}, q AS (SELECT *, {COMPONENT.format('src')} AS da, {PIN.format('src')} AS pin_da, {COMPONENT.format('dst')} AS a, {PIN.format('dst')} AS pin_a FROM p) SELECT id, da, pin_da, CASE WHEN pin_da <> '' THEN da || ' | ' || pin_da ELSE da END AS da_inizio, a, pin_a, CASE WHEN pin_a <> '' THEN a || ' | ' || pin_a ELSE a END AS a_fine, coalesce(cable, '') AS cavo, coalesce(CAST(length_mm AS VARCHAR), '') AS lunghezza_mm, CAST(page AS VARCHAR) AS pagina, coalesce(note, '') AS note FROM q")
def wire_sheet(spark, d):
    """The wire list's sheet, with both ends as component and pin."""
    return wires.wire_sheet(_ends(spark, d))


@query(f"WITH {_ENDS}, e AS (SELECT id, note, 'A' AS estremita, src AS sigla FROM p WHERE src <> '' UNION ALL SELECT id, note, 'B', dst FROM p WHERE dst <> '') SELECT {COMPONENT.format('sigla')} AS componente, {PIN.format('sigla')} AS pin, sigla, id AS id_filo, estremita, coalesce(note, '') AS note FROM e")
def label_sheet(spark, d):
    """The label sheet: a row for each end."""
    return wires.label_sheet(_ends(spark, d))


@query("SELECT '' AS componente, '' AS pin, '' AS sigla, '' AS id_filo, '' AS estremita, 'Nessun filo estratto' AS note")
def label_sheet_empty(spark, d):
    """The label sheet of no wires: one row that says so."""
    return wires.label_sheet(_ends(spark, d).filter("page < 0"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS rif, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, '') AS descrizione, CAST(p_size AS VARCHAR) AS quantita, p_brand AS produttore FROM part")
def component_sheet(spark, d):
    return wires.component_sheet(table(spark, d, "part").selectExpr("p_partkey AS ref", "CASE WHEN p_size % 2 = 0 THEN p_name END AS description", "p_size AS quantity", "p_brand AS manufacturer"))


@query(r"SELECT doc_id, CAST(i AS INT) AS riga, list_extract(string_split_regex(coalesce(text,''), '\r?\n'), i) AS testo FROM documents, unnest(range(1, len(string_split_regex(coalesce(text,''), '\r?\n')) + 1)) AS u(i)")
def text_sheet(spark, d):
    """Numbered lines of every text."""
    return wires.text_sheet(table(spark, d, "documents"), "doc_id", "text")


BLOCKS = ["concat(CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN 'xt' ELSE 'XT' END, CAST(s_suppkey % 130 AS {s}), '.', CAST(s_nationkey AS {s})) AS src", "concat('KM', CAST(s_suppkey AS {s})) AS dst", "s_suppkey AS ord"]


@query(f"WITH w AS (SELECT {', '.join(x.format(s='VARCHAR') for x in BLOCKS)} FROM supplier), n AS (SELECT upper(regexp_extract(src, '(?i)^-?(XT\\d+)', 1)) AS name, min(ord) AS ord FROM w GROUP BY 1), x AS (SELECT a.name, arg_min(b.name, b.ord) AS fixed FROM n a JOIN n b ON length(b.name) = length(a.name) + 1 AND substring(b.name, 4) = substring(a.name, 3) GROUP BY 1) SELECT CASE WHEN fixed IS NULL THEN src ELSE (CASE WHEN starts_with(src, '-') THEN '-' ELSE '' END) || fixed || regexp_extract(src, '(?i)^-?XT\\d+(.*)$', 1) END AS src, dst, w.ord FROM w LEFT JOIN x ON x.name = upper(regexp_extract(src, '(?i)^-?(XT\\d+)', 1))")
def corrected_blocks(spark, d):
    """Terminal blocks that lost their first digit, rewritten in the wires."""
    return wires.correct_blocks(table(spark, d, "supplier").selectExpr(*[x.format(s="STRING") for x in BLOCKS]))


@query(f"WITH {WSQL} SELECT id, ord, src, dst, sheet = 100 AS panel FROM w0 WHERE sheet = 100 OR contains(lower(src), 'rimando') OR contains(lower(dst), 'rimando')")
def panel_union(spark, d):
    """A panel's wires, and of other panels those that touch a reference, told apart by a flag."""
    w = _wires(spark, d).select("id", "ord", "src", "dst", "sheet")
    return wires.with_panel_flag(w.filter("sheet = 100"), w.filter("sheet <> 100")).drop("sheet")


COORDS = ["CAST(p_partkey AS {s}) AS id", "CASE WHEN p_size % 3 = 0 THEN ' 105.1 ' WHEN p_size % 3 = 1 THEN '-7,25' ELSE 'QM1.2' END AS src", "CASE WHEN p_partkey % 2 = 0 THEN '33' ELSE 'X1' END AS dst", "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 < 3 THEN 'nota' END AS note"]


@query(r"WITH w AS (SELECT " + ", ".join(x.format(s="VARCHAR") for x in COORDS) + r" FROM part), m AS (SELECT *, regexp_matches(trim(src), '^-?\d+([.,]\d+)?$') AS a, regexp_matches(trim(dst), '^-?\d+([.,]\d+)?$') AS b FROM w) SELECT id, CASE WHEN a THEN 'rimando ' || trim(src) ELSE src END AS src, CASE WHEN b THEN 'rimando ' || trim(dst) ELSE dst END AS dst, concat_ws(' | ', nullif(note, ''), CASE WHEN a THEN 'rimando/coord: ' || trim(src) END, CASE WHEN b THEN 'rimando/coord: ' || trim(dst) END) AS note FROM m")
def marked_references(spark, d):
    return wires.marked_notes(table(spark, d, "part").selectExpr(*[x.format(s="STRING") for x in COORDS]))


SUFFIXES = ["CASE p_partkey % 5 WHEN 0 THEN '-QM102/1' WHEN 1 THEN 'QM104: 7 ' WHEN 2 THEN 'KM3' WHEN 3 THEN 'A.B:1' END AS ref", "CASE WHEN p_size % 2 = 0 THEN 'x' END AS note", "p_partkey"]


@query(r"WITH c AS (SELECT " + ", ".join(SUFFIXES) + r" FROM part), m AS (SELECT *, coalesce(regexp_matches(ref, '^(-?[A-Za-z0-9]+)[:\\/](.*)$'), false) AS hit FROM c) SELECT p_partkey, CASE WHEN hit THEN regexp_extract(ref, '^(-?[A-Za-z0-9]+)', 1) ELSE ref END AS ref, concat_ws(' | ', nullif(note, ''), CASE WHEN hit THEN 'terminale/suffisso: ' || trim(regexp_extract(ref, '[:\\/](.*)$', 1)) END) AS note FROM m")
def split_suffixes(spark, d):
    return wires.split_suffix(table(spark, d, "part").selectExpr(*SUFFIXES)).select("p_partkey", "ref", "note")


# ---- catalogue

_SEEN = "enabled AND visibility IN ('public','beta')"


@query(f"SELECT DISTINCT mcp_id, mcp_name FROM registry WHERE {_SEEN} AND mcp_id = (SELECT min(mcp_id) FROM registry WHERE {_SEEN})")
def registry_lookup(spark, d):
    """One visible entry by its id."""
    r = table(spark, d, "registry")
    first = registry.visible(r).agg(F.min("mcp_id")).first()[0]
    return registry.lookup(r, first).select("mcp_id", "mcp_name").distinct()


@query(f"SELECT mcp_id, category FROM registry WHERE {_SEEN} AND featured AND regexp_matches(concat_ws(' ', mcp_name, description, array_to_string(tags, ' ')), '(?i)a')")
def registry_featured(spark, d):
    return registry.listed(table(spark, d, "registry"), featured="true", search="a").select("mcp_id", "category")


@query(f"SELECT mcp_id FROM registry WHERE {_SEEN} AND category = 'productivity'")
def registry_category(spark, d):
    """The entries of a category; a ``featured`` that isn't 'true' asks for nothing."""
    return registry.listed(table(spark, d, "registry"), category="productivity", featured="yes").select("mcp_id")


@query("SELECT mcp_id, list_transform(list_filter(tags, lambda t: trim(coalesce(t, '')) <> ''), lambda t: upper(trim(t)[1]) || substring(trim(t), 2)) AS tags, coalesce(docker_tag, 'latest') AS docker_tag, coalesce(transport, 'stdio') AS transport, 'node /app/dist/index.js' AS entrypoint FROM registry")
def manifest_projection(spark, d):
    """The public form of an entry, with its defaults."""
    return registry.projected(table(spark, d, "registry")).withColumn("tags", F.transform("tags", tx.capitalised)).select("mcp_id", "tags", "docker_tag", "transport", "entrypoint")


@query("WITH m AS (SELECT mcp_id, json_object('name', upper(mcp_name), 'icon', 'i.png') AS j FROM registry WHERE port % 2 = 0) SELECT DISTINCT r.mcp_id, coalesce(m.j->>'name', r.mcp_name) AS name, m.j->>'icon' AS icon, CASE WHEN m.j IS NOT NULL THEN 'icon,name' ELSE '' END AS given FROM registry r LEFT JOIN (SELECT DISTINCT * FROM m) m USING (mcp_id)")
def manifest_presence(spark, d):
    """Entries merged with manifests whose keys differ from file to file: also keys that the entry lacks go through."""
    r = table(spark, d, "registry")
    m = r.filter("port % 2 = 0").select("mcp_id", F.to_json(F.struct(F.upper("mcp_name").alias("name"), F.lit("i.png").alias("icon"))).alias("manifest")).distinct()
    out = registry.merge_json(r.select("mcp_id", F.to_json(F.struct(F.col("mcp_name").alias("name"))).alias("doc")).distinct(), m, "mcp_id")
    return out.select("mcp_id", F.col("merged")["name"].alias("name"), F.col("merged")["icon"].alias("icon"), F.array_join(F.array_sort("given"), ",").alias("given")).distinct()


CHANGES = ["s_suppkey % 7 + CASE WHEN s_suppkey % 2 = 0 THEN 100000 ELSE 0 END AS s_suppkey", "s_name", "s_suppkey AS ord"]


@query(f"WITH n AS (SELECT {', '.join(CHANGES)} FROM supplier), f AS (SELECT s_suppkey, arg_min(s_name, ord) AS s_name FROM n GROUP BY 1) SELECT s_suppkey, s_name, CAST(NULL AS TIMESTAMP) AS created_at FROM supplier UNION ALL SELECT s_suppkey, s_name, TIMESTAMP '2024-05-01 00:00:00' FROM f WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_stamped(spark, d):
    """New rows with their time; of several new ones with a key the first is inserted."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    n = table(spark, d, "supplier").selectExpr(*CHANGES)
    return registry.insert_once(s, n, "s_suppkey", "ord", {"created_at": F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")})


# ---- stored results

@query()
def stored_query(spark, d):
    """Items of stored lists that match a filter document, with the total and whether more follow; tested against a literal model."""
    items = table(spark, d, "stored_response").selectExpr("response_id", "explode(from_json(get_json_object(summary, '$.firstItems'), 'array<string>')) AS item")
    return store.query_items(items.distinct(), "item", {"stato": "aperto"}, ["response_id", "item"], offset=5, limit=10)


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) = 7 AND CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-20'")
def json_filter_document(spark, d):
    """A filter document over JSON: all its parts hold, with dotted keys and a range of times inside the value."""
    e = table(spark, d, "events")
    j = e.select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct(F.date_format("ts", "yyyy-MM-dd").alias("at")).alias("a"))).alias("j"))
    return j.filter(store.matches(F.col("j"), {"k": 7, "a.at": {"$gte": "2024-01-05", "$lt": "2024-01-20"}})).select("event_id")


@query("SELECT 100 AS take, 1000 AS skip, count(*) AS total, count(*) > 1100 AS has_more FROM orders")
def paged(spark, d):
    """Page 3 of a size above the greatest one."""
    skip, take = store.paging(3, 500)
    return table(spark, d, "orders").agg(F.lit(take).alias("take"), F.lit(skip).alias("skip"), F.count("*").alias("total"), (F.count("*") > skip + take).alias("has_more"))


@query("""SELECT 'p_partkey,p_name,p_size' AS line, 0 AS ord UNION ALL SELECT CASE WHEN p_partkey = 0 THEN '""' ELSE CAST(p_partkey AS VARCHAR) END || ',' || '"' || replace(p_name, '"', '\\"') || '"' || ',' || CASE WHEN coalesce(p_size, 0) = 0 THEN '""' ELSE CAST(p_size AS VARCHAR) END, 1 FROM part""")
def csv_export(spark, d):
    """An exported file's lines: the header and the rows."""
    return store.csv_lines(table(spark, d, "part").select("p_partkey", "p_name", "p_size"))


# ---- mail and scans

@query("SELECT DISTINCT msg_id, coalesce(subject, 'No Subject') AS subject, coalesce(sender, 'No Sender') AS sender, coalesce(recipient, 'No Recipient') AS recipient, coalesce(sent_date, 'No Date') AS date, coalesce(snippet, 'No Snippet') AS snippet, list_contains(string_split(coalesce(label, ''), ','), 'STARRED') AS starred FROM emails")
def mail_details(spark, d):
    """Headers by name, with the defaults of missing ones."""
    pair = lambda n, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(c).alias("value")))
    e = table(spark, d, "emails").select("msg_id", "snippet", F.split(F.coalesce("label", F.lit("")), ",").alias("labels"), F.array_compact(F.array(pair("Subject", "subject"), pair("FROM", "sender"), pair("to", "recipient"), pair("Date", "sent_date"))).alias("headers"))
    return docs.mail_details(e).select("msg_id", "subject", "sender", "recipient", "date", "snippet", "starred").distinct()


@query("SELECT DISTINCT msg_id, coalesce(CASE WHEN has_attachments THEN coalesce(body, '') ELSE body END, '<Text body not available>') AS body FROM emails")
def mail_bodies(spark, d):
    """The plain part of a message of parts within parts, or the data of a single one."""
    data = F.translate(F.base64(F.encode("body", "UTF-8")), "+/\r\n", "-_")
    part = lambda kind, c: F.struct(F.lit(kind).alias("mimeType"), F.struct(c.alias("data")).alias("body"))
    one = F.struct(F.struct(data.alias("data")).alias("body"))
    many = F.struct(F.array(F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part("text/html", F.lit("eA")), part("text/plain", F.coalesce(data, F.lit("")))).alias("parts"))).alias("parts"))
    payload = F.when(F.col("has_attachments"), F.to_json(many)).otherwise(F.to_json(one))
    return table(spark, d, "emails").select("msg_id", docs.mime_body(payload).alias("body")).distinct()


@query("(SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 20)")
def typed_scan(spark, d):
    """The second page of a search with a given segment; parameters without a value don't filter."""
    spec = scans.Scan(text="c_name", equal={"segment": "c_mktsegment", "nation": "c_nationkey"}, order=("c_custkey",))
    return spec.run(table(spark, d, "customer"), {"search_text": "1", "segment": "BUILDING", "nation": None, "page": 2}).select("c_custkey", "c_name")


@query("(SELECT o_custkey, CAST(sum(o_totalprice) AS DECIMAL(18, 2)) AS balance FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 1 LIMIT 100)")
def account_balances(spark, d):
    """Balances by account, the first hundred accounts, as the report has."""
    return scans.balances(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "o_custkey", "o_totalprice").select("o_custkey", F.col("balance").cast("decimal(18,2)").alias("balance"))


@query("SELECT n_nationkey, 'https://h.example/q?vector=' || n_name AS url, least(100, greatest(0, CAST(floor(n_nationkey * 7.3 + 0.5) AS BIGINT))) AS percent, upper(n_name[1]) || substring(lower(n_name), 2) AS label, 'Paese ' || n_name || ' di {regione}' AS prompt FROM nation WHERE n_name NOT LIKE '% %'")
def small_functions(spark, d):
    """Addresses, progress, capitals and templates."""
    n = table(spark, d, "nation").filter("n_name not like '% %'")
    return n.select("n_nationkey", tx.url(F.lit("https://h.example/"), F.lit("q"), {"vector": F.col("n_name"), "none": F.lit(None).cast("string")}).alias("url"), tx.percent(F.col("n_nationkey") * 7.3).alias("percent"), tx.capitalised(F.lower("n_name")).alias("label"), tx.template("Paese {nome} di {regione}", {"nome": F.col("n_name")}).alias("prompt"))
