"""Wire reports, mapping-driven reconciliation, stored results, mail and scans: odd inputs and literal models."""

import base64
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from graticule.functions import text as tx
from graticule.operators import docs, mapping, reconcile, registry, store, wires
from graticule.sources import scans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_kinds_of_all_prefixes(spark):
    kinds = {"breaker": "QF QM QS", "relay": "KM KA K", "power": "TS PS G", "terminal": "XT X", "fuse": "FS FU", "switch": "SB SA S", "lamp": "HL H", "plc": "AP PLC CPU", "motor": "M MOT", "other": "Q T F AB KX"}
    rows = [(f"{dash}{case(p)}{n}", k) for k, ps in kinds.items() for p in ps.split() for dash, case, n in (("", str, "12"), ("-", str.lower, "3.1"), ("", str, ""))]
    got = spark.createDataFrame(rows, "ref string, want string").withColumn("kind", wires.component_kind(F.col("ref"))).collect()
    assert all(r["kind"] == r["want"] for r in got) and sum(len(p.split()) for k, p in kinds.items() if k != "other") == 23


def test_lengths(spark):
    xs = ["2,5", "1,5,2", "-3", "2000000", " 12 ", "abc", "", None, "1e3", "0"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(wires.clean_length(F.col("x"), False)).collect()]
    assert got == [2.5, None, None, None, 12.0, None, None, None, 1000.0, None]
    numbers = [-5.0, 2e6, float("nan"), float("inf"), 0.0, None]
    assert [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(wires.clean_length(F.col("x"))).collect()] == [-5.0, 2e6, None, None, 0.0, None]


def test_reference_groups_local_and_spread(spark, monkeypatch):
    rnd = random.Random(1)
    ref = lambda: f"rimando {rnd.randint(1, 6)}@{rnd.randint(1, 6)}"
    rows = [(f"w{i % 5}", ref() if rnd.random() < 0.7 else f"A{rnd.randint(1, 9)}.1", ref() if rnd.random() < 0.7 else f"B{rnd.randint(1, 9)}.1") for i in range(80)]
    df = spark.createDataFrame(rows, "id string, src string, dst string")
    local = {tuple(r) for r in wires.resolve(df).collect()}
    monkeypatch.setattr(wires, "LOCAL_EDGES", 3)
    assert {tuple(r) for r in wires.resolve(df).collect()} == local and local
    assert wires.resolve(df.limit(0)).count() == 0


def test_fold_of_repeats(spark):
    rows = [("1", "A", "B", 1, None, None, "n1", 5), ("1", "A", "B", 2, "c", float("nan"), None, 6), ("1", "A", "B", 3, "c", 2.0, " ", 7), ("1", "A", "B", 4, "d", 2.0, None, 8), ("1", "B", "A", 5, None, None, None, 9)]
    got = {(r["src"], r["dst"]): r for r in wires.merge_duplicates(spark.createDataFrame(rows, "id string, src string, dst string, ord int, cable string, length_mm double, note string, page int")).collect()}
    # 2 is no better than 1 (its note makes up for the cable); 3 is, and the joined note then counts for it
    assert (got["A", "B"]["cable"], got["A", "B"]["page"], got["A", "B"]["note"], got["A", "B"]["ord"]) == ("c", 7, "n1 |  ", 1)
    assert got["B", "A"]["page"] == 9


def test_empty_sheets(spark):
    w = spark.createDataFrame([], "id string, src string, dst string, cable string, length_mm double, note string")
    assert [set(r) for r in wires.wire_sheet(w).collect()] == [{""}]
    assert wires.label_sheet(w).first()["note"] == "Nessun filo estratto"
    assert wires.component_sheet(spark.createDataFrame([], "ref string, description string")).count() == 1


def test_best_match_of_long_keys(spark, monkeypatch):
    random.seed(3)
    word = lambda: "-".join(random.choice("abcdefg") + random.choice("12") for _ in range(random.randint(1, 6)))
    left, right = sorted({word() for _ in range(80)}), sorted({word() for _ in range(80)})
    random.shuffle(right)
    a, b = spark.createDataFrame([(x,) for x in left], "t_key string"), spark.createDataFrame([(x, i) for i, x in enumerate(right)], "f_key string, pos int")
    want = {}
    for x in left:
        scores = [(len(set(x.split("-")) & set(y.split("-"))) / len(set(x.split("-")) | set(y.split("-"))), -i, y) for i, y in enumerate(right)]
        s, _, y = max(scores)
        if s >= 0.5:
            want[x] = (y, round(s, 9))
    for listed in (10, 3, 1):
        monkeypatch.setattr(reconcile, "LISTED", listed)
        assert {r[0]: (r[1], round(r[2], 9)) for r in reconcile.best_match(a, b, 0.5).collect()} == want


def test_hot_tokens_cost_a_row_per_key(spark):
    a = spark.createDataFrame([(f"gfz-str-{i}",) for i in range(400)], "t_key string")
    b = spark.createDataFrame([(f"gfz-str-{i + 200}", i) for i in range(400)], "f_key string, pos int")
    toks = lambda df, key: df.select("*", F.array_sort(tx.tokens(F.col(key))).alias("t"))
    first = reconcile._token_sets(toks(b, "f_key"), "t", 0.5).groupBy("sub", F.col("n").alias("m")).agg(F.min("pos"))
    met = reconcile._token_sets(toks(a, "t_key"), "t", 0.5).join(first, "sub").count()
    assert met <= 7 * 400  # all pairs that share a hot token would be 160,000
    got = {r[0]: r[1] for r in reconcile.best_match(a, b, 0.5).collect()}
    assert got["gfz-str-300"] == "gfz-str-300" and got["gfz-str-5"] == "gfz-str-200"


def test_mapping(spark):
    t = spark.createDataFrame([(1, "A-1", "uno", None), (2, "a 1", "altro", "x"), (3, None, "zero", None), (4, "B-2", "", "y")], "n int, c string, d string, e string")
    f = spark.createDataFrame([("k1", "A-1", "uno"), ("k2", "C-9", "tre")], "document_id string, c string, d string")
    fields = (mapping.Field("Codice", ("c",)), mapping.Field("testo", ("d",)))
    maps = (mapping.Mapping("testo"), mapping.Mapping("codice", True), mapping.Mapping("nulla"))
    assert mapping.primary(maps).name == "codice" and mapping.primary(maps[:1]).name == "testo" and mapping.source_columns(fields + fields) == ["c", "d"]
    got = {r["primary_key"]: r for r in mapping.compare([mapping.Source("t", t, fields, "n")], f, fields, maps).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a-1": "matched", "b-2": "missing_from_folder", "c-9": "missing_from_table"}
    r = got["a-1"]["field_results"]["testo"]
    assert (r["table_value"], r["matched"], r["similarity"]) == ("uno", True, 1.0) and not got["b-2"]["field_results"]["codice"]["matched"]
    assert mapping.compare([mapping.Source("t", t.limit(0), fields, "n")], f.limit(0), fields, maps).count() == 0
    d = {r["side"]: r for r in mapping.diagnostics([mapping.Source("t", t, fields, "n")], f, fields, maps).collect()}
    assert (d["t"]["total"], d["t"]["filtered"], d["folder"]["empty"]) == (4, 1, False)
    assert [r[0] for r in mapping.sample_keys(f, "c", 1).collect()] == ["A-1"]
    with pytest.raises(ValueError):
        mapping.primary([])


def test_registry_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in registry.update(t, twice, "k", ["v"]).collect()) == [(1, "y"), (2, "b")]
    docs_ = spark.createDataFrame([(1, '{"a": "1", "b": "2"}'), (2, None)], "k int, doc string")
    files = spark.createDataFrame([(1, '{"a": null, "c": "3"}')], "k int, manifest string")
    got = {r["k"]: r for r in registry.merge_json(docs_, files, "k").collect()}
    assert got[1]["merged"] == {"a": "1", "b": "2", "c": "3"} and got[2]["merged"] == {}
    assert {r["k"]: r for r in registry.merge_json(docs_, files, "k", ()).collect()}[1]["merged"] == {"a": None, "b": "2", "c": "3"}
    r = spark.createDataFrame([("a", True, "public", "x"), ("a", False, "public", "x")], "mcp_id string, enabled boolean, visibility string, category string")
    assert registry.lookup(r, "a").count() == 1 and registry.listed(r, category="y").count() == 0


def test_stored_items(spark):
    rows = [(i, json.dumps({"a": {"s": s}, "t": t})) for i, (s, t) in enumerate([("x", "2024-01-05"), ("x", 1704499200000), ("x", "later"), (None, "2024-01-06"), ("y", "2024-01-06"), ("x", "2024-02-01")])] + [(9, "[")]
    df = spark.createDataFrame(rows, "id int, item string")
    out = store.query_items(df, "item", {"a.s": "x", "t": {"$gte": "2024-01-05", "$lte": "2024-01-31"}}, ["id"], 1, 1).collect()
    assert [(r["id"], r["total"], r["has_more"]) for r in out] == [(1, 2, False)]
    assert store.paging(3, 500) == (1000, 100) and store.paging() == (0, 20)
    s = {r["id"]: r for r in store.summaries(spark.createDataFrame([(1, '[{"b": 1, "a": 2}, null, 3, 4]'), (2, '{"z": 1, "data": [1, 2]}'), (3, "x{")], "id int, v string"), "id", "v").collect()}
    assert (s[1]["items"], s[1]["item_keys"], s[1]["first_items"].count("\n")) == (4, "b,a", 2) and (s[2]["keys"], s[2]["data_length"]) == ("z,data", 2) and s[3]["kind"] == "unreadable"


def test_mail_parts(spark):
    b = lambda t: base64.urlsafe_b64encode(t.encode()).decode()
    plain = lambda t: {"mimeType": "text/plain", "body": {"data": b(t)}}
    cases = [
        ({"body": {"data": b("ciao è?>")}}, "ciao è?>"), ({"body": {}}, docs.NO_BODY), ({"parts": [{"mimeType": "text/html", "body": {"data": b("x")}}]}, docs.NO_BODY),
        ({"parts": [{"mimeType": "m", "parts": [{"mimeType": "m", "parts": [plain("deep")]}]}, plain("late")]}, "deep"), ({"body": {"data": "é"}}, docs.BAD_BODY),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)] + [(98, None), (99, "{")], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(docs.mime_body("p")).collect()] == [w for _, w in cases] + [docs.NO_BODY, docs.BAD_BODY]
    m = spark.createDataFrame([("1", [("Subject", "a"), ("SUBJECT", "b")], ["X", "STARRED"], None)], "msg_id string, headers array<struct<name:string,value:string>>, labels array<string>, snippet string")
    r = docs.mail_details(m).first()
    assert (r["subject"], r["sender"], r["starred"], r["label"], r["snippet"]) == ("b", "No Sender", True, "X,STARRED", "No Snippet")


def test_clauses(spark):
    df = spark.createDataFrame([(["a", " ", None],), ([],), (None,)], "c array<string>")
    assert tuple(docs.clause_counts(df, F.col("c")).first()) == (3, 3, 1)
    t = spark.createDataFrame([(1, 0, "b"), (1, 1, "zz")], "k int, pos int, clause string")
    s = spark.createDataFrame([(1, 0, "a"), (1, 1, " b c")], "k int, ord int, section string")
    assert [r["section"] for r in docs.context(t, s, "k", text=True).orderBy("pos").collect()] == [" b c", docs.MISSING]
    o = spark.createDataFrame([(1, "x"), (2, "y")], "k int, item string")
    assert sorted(tuple(r) for r in docs.zipped_all(o, [(o.selectExpr("k", "item AS r1").filter("k = 1"), "r1", "-"), (o.selectExpr("k", "item AS r2"), "r2", "-")], ["k"]).select("k", "r1", "r2").collect()) == [(1, "x", "x"), (2, "-", "y")]


def test_scans_and_small_functions(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i % 3}", i % 2) for i in range(300)], "k int, name string, g int")
    spec = scans.Scan("name", {"g": "g"}, ("k",))
    assert [r["k"] for r in spec.run(df, {"search_text": "N1", "g": 0, "page_size": 2, "page": 2}).collect()] == [16, 22]
    assert spec.run(df, {"search_text": None, "page_size": 500}).count() == 100
    with pytest.raises(ValueError):
        spec.run(df, {"other": 1})
    assert scans.path_of("/a/{id}/b", {"id": "x y/z"}) == "/a/x%20y%2Fz/b"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 70000) + b"rest"
    sizes = scans.png_size(spark.createDataFrame([(png,), (b"no",), (None,)], "content binary")).collect()
    assert [(r["width"], r["height"]) for r in sizes] == [(640, 70000), (None, None), (None, None)]
    assert [tuple(r) for r in scans.page_texts(spark.createDataFrame([(1, "a\f \fb")], "k int, t string"), "k", "t").collect()] == [(1, 1, "a"), (1, 3, "b")]
    (tmp_path / "c.json").write_text('{"mail": ["a", "b"]}')
    assert scans.category_file(spark, str(tmp_path / "c.json")).count() == 2 and scans.category_file(spark, str(tmp_path / "none.json")).count() == 0
    assert [one(spark, tx.percent(F.lit(x))) for x in (-3.0, 49.5, 400.0)] == [0, 50, 100]
    assert one(spark, tx.tag_list(F.lit(" a, ,b"))) == ["a", "b"] and one(spark, tx.command_line(F.array(F.lit("node"), F.lit("x.js")))) == "node x.js"
    assert one(spark, tx.url_parameter(F.lit("http://h/x?code=4%2Fa&s=1"), "code")) in ("4%2Fa", "4/a")
    assert [one(spark, tx.first_text(F.lit(x))) for x in ('{"a": 1, "b": "x", "c": "y"}', '{"a": 1}', "[")] == ["x", None, None]
    assert one(spark, tx.template("{a} {b}", {"a": F.lit("x")})) == "x {b}"
    names = spark.createDataFrame([("p-10.png",), ("p-2.png",), ("x.png",)], "n string")
    assert [r[0] for r in names.orderBy(*wires.page_order(F.col("n"))).collect()] == ["x.png", "p-2.png", "p-10.png"]
