"""Problems 2, 6 and 7: small cases, odd inputs, brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from graticule.operators import compare, nested, widen

AT = dt.datetime(2024, 1, 1)
CATALOG = [("codice", "text"), ("pagine", "int"), ("importo", "decimal"), ("data_emissione", "date"), ("approvato", "bool")]


def wide(spark, rows, **extra):
    df = spark.createDataFrame(rows, "document_id string, field_name string, value_text string, loaded_at timestamp")
    return {r["document_id"]: r for r in widen.widen(df.withColumns(extra) if extra else df, CATALOG).collect()}


def test_widen_notations(spark):
    cases = {
        "pagine": [(" 03 ", 3), ("3.0", 3), ("0,0", 0), ("+12", 12), ("12 o 13", None), ("3.5", None), ("1.2.3.4", None), ("1.000", 1000)],
        "importo": [("€ 1.234,5", "1234.50"), ("1,234.56", "1234.56"), ("1'234.56", "1234.56"), ("1 234,50 €", "1234.50"), ("-12 kg", "-12.00"), ("31/02/2024", None), ("EUR 10,005", "10005.00"), ("1.2.3.4", None)],
        "data_emissione": [("3/1/24", "2024-01-03"), ("31-12-2023", "2023-12-31"), ("2023-07-04T00:00:00Z", "2023-07-04"), ("19° Aprile 2021", "2021-04-19"), ("May 17, 2019", "2019-05-17"), ("20210103", "2021-01-03"), ("31/02/2024", None), ("14/13/2023", None)],
        "approvato": [("Sì", True), ("NO", False), ("1", True), ("F", False), ("boh", None)],
        "codice": [("\t a b ", "a b"), ("n.d.", None), ("-", None), ("", None), ("x" * 100_000, "x" * 100_000)],
    }
    rows = [(f"{c}{i}", c, v, AT) for c, xs in cases.items() for i, (v, _) in enumerate(xs)]
    got = wide(spark, rows)
    for c, xs in cases.items():
        for i, (v, want) in enumerate(xs):
            cell = got[f"{c}{i}"][c]
            assert (str(cell) if isinstance(want, str) and cell is not None else cell) == want, (c, v[:40], cell)


def test_widen_latest_ties_nulls_and_extra_columns(spark):
    later = AT + dt.timedelta(days=1)
    rows = [("a", " Codice:", "old", AT), ("a", "CODICE", "new", later), ("a", "codice", "new", later), ("b", "codice", "x", AT), ("b", "codice", "??", later), ("b", "Data Emissione", "boh", later), ("b", "data-emissione", "2024-01-01", AT),
            ("c", "altro", "1", AT), (None, "codice", "n", AT), ("d", None, "1", AT), ("e", "codice", "a", AT), ("e", "codice", "b", AT), ("f", "codice", "z", None)]
    got = wide(spark, rows, _pos=F.lit(1), _cells=F.lit("x"), g=F.lit(2))
    assert got["a"]["codice"] == "new" and got["b"]["data_emissione"] is None and got["c"]["codice"] is None and got[None]["codice"] == "n"
    assert set(got) == {"a", "b", "c", None, "d", "e", "f"} and got["e"]["codice"] == "b" and got["f"]["codice"] == "z"
    assert wide(spark, []) == {}


def test_nested_json(spark):
    rows = [
        ("a", json.dumps({"righe": [{"x": 1, "lotti": [{"l": 1}, None]}, None, {"x": 2}]})),
        ("b", json.dumps({"righe": {"x": 1, "lotti": {"l": 2}}})),
        ("c", json.dumps({"righe": json.dumps([None, {"x": 3}])})),
        ("d", "﻿" + json.dumps({"fasi": [[{"f": 1}, {"f": 2}], []]})),
        ("e", '{"righe": [{"x"'), ("f", None), ("g", ""), ("h", json.dumps({"righe": "", "note": ["a"], "cliente": {"sede": {"p": 1}}})), ("a", json.dumps({"righe": []})),
    ]
    df = spark.createDataFrame(rows, "id string, summary string").withColumn("record_id", F.lit("clash"))
    flat = nested.flatten_json(df, "id", "summary")
    got = {(r["record_id"], r["parent_path"], r["child_path"]) for r in flat.collect()}
    assert got == {("a", "", "righe[0]"), ("a", "righe[0]", "righe[0].lotti[0]"), ("a", "", "righe[2]"), ("b", "", "righe[0]"), ("b", "righe[0]", "righe[0].lotti[0]"), ("c", "", "righe[1]"), ("d", "", "fasi[0][0]"), ("d", "", "fasi[0][1]")}
    keys = {r["row_key"] for r in flat.collect()}
    assert all(r["parent_key"] in keys for r in flat.collect() if r["parent_path"])
    child = nested.child_table(flat, "righe")
    assert "x" in child.columns and child.count() == 4
    empty = spark.createDataFrame([], "id string, summary string")
    assert nested.flatten_json(empty, "id", "summary").count() == 0


def test_nested_columns(spark):
    df = spark.createDataFrame([("a", ["x", None, ""], ({"k": None, "l": "v"}, [[1], [2, 3]])), ("b", None, None), ("c", [], (None, []))], "id string, tags array<string>, d struct<m: map<string,string>, n: array<array<int>>>")
    got = {(r["record_id"], r["child_path"]) for r in nested.flatten_columns(df, "id", ["tags", "d"]).collect()}
    assert got == {("a", "tags[0]"), ("a", "tags[2]"), ("a", "d.m.k"), ("a", "d.m.l"), ("a", "d.n[0]"), ("a", "d.n[1]"), ("a", "d.n[0][0]"), ("a", "d.n[1][0]"), ("a", "d.n[1][1]")}


SCHEMA = "primary_key string, status string, match_score double, source_table string, field_results map<string,struct<table_value string, folder_value string, matched boolean, similarity double>>, document_id string, document_name string, updated_at timestamp"


def sides(spark, a, b):
    out = compare.compare(spark.createDataFrame(a, SCHEMA).withColumn("_bucket", F.lit(1)), spark.createDataFrame(b, SCHEMA))
    return sorted(map(tuple, out.collect()), key=repr)


def test_compare_cases(spark):
    f = {"codice": ("a", "b", True, 0.5), "data": ("x", None, None, None)}
    base = ("k", "s", 0.5, "t", f, "d", "n", AT)
    change = lambda **x: tuple(x.get(c.split()[0], v) for c, v in zip(["primary_key", "status", "match_score", "source_table", "field_results", "document_id", "document_name", "updated_at"], base))
    assert sides(spark, [base, base], [change(updated_at=AT + dt.timedelta(days=9))]) == []
    assert sides(spark, [base], [change(match_score=0.5 + 1e-12)]) == []
    assert sides(spark, [base], [change(match_score=0.5 + 1e-8, status=None)]) == [("k", "differs", "match_score"), ("k", "differs", "status")]
    assert sides(spark, [change(field_results=None)], [change(field_results={})]) == []
    assert sides(spark, [base], [change(field_results={"codice": ("a", "c", True, 0.5)})]) == [("k", "differs", "codice.folder_value"), ("k", "differs", "data")]
    assert sides(spark, [base], [change(field_results=None)]) == [("k", "differs", "codice"), ("k", "differs", "data")]
    old, new = change(status="old"), change(status="new", updated_at=AT + dt.timedelta(days=1))
    assert sides(spark, [old, new], [new]) == []
    assert sides(spark, [base], []) == [("k", "missing_in_copy", "")] and sides(spark, [], [change(primary_key=None)]) == [(None, "missing_in_entries", "")] and sides(spark, [], []) == []


def test_compare_any_number_of_buckets(spark):
    random.seed(4)
    make = lambda i, s: (f"k{i}", s, i / 7, "t", {"a": (s, None, True, None)}, "d", None, AT)
    a = [make(i, random.choice("xy")) for i in range(300)]
    b = [make(i, random.choice("xy")) for i in range(10, 310)]
    want = sides(spark, a, b)
    for n in (1, 7, 5000):
        got = compare.compare(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), buckets=n)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    x, y = {r[0]: r for r in a}, {r[0]: r for r in b}
    assert {r[0] for r in want} == {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)}


def test_compare_sees_swapped_nulls(spark):
    make = lambda *member: [("k", "s", 0.5, "t", {"data": member}, "d", "n", AT)]
    assert sides(spark, make("x", None, True, 0.5), make(None, "x", True, 0.5)) == [("k", "differs", "data.folder_value"), ("k", "differs", "data.table_value")]


def test_deep_and_repeatedly_encoded_records(spark):
    deep = lambda n: '{"rows": [' + '{"a": ' * n + '{"b": [{"c": 1}]}' + "}" * n + "]}"
    thrice = json.dumps(json.dumps(json.dumps({"rows": [{"x": 1}, {"x": 2}]})))
    rows = [("d1", deep(2_000)), ("d2", deep(20_000)), ("t", thrice), ("bad", '{"rows": [{"a": ' * 3_000), ("two", '{"rows": []} x')]
    got = nested.flatten_json(spark.createDataFrame(rows, "id string, v string"), "id", "v").collect()
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r)
    assert set(by) == {"d1", "d2", "t"} and sorted(r["child_path"] for r in by["t"]) == ["rows[0]", "rows[1]"]
    for name, n in (("d1", 2_000), ("d2", 20_000)):
        outer, inner = sorted(by[name], key=lambda r: len(r["child_path"]))
        assert outer["child_path"] == "rows[0]" and inner["parent_key"] == outer["row_key"]
        assert inner["child_path"] == "rows[0]." + "a." * n + "b[0]" and inner["content"] == '{"c": 1}'
        assert outer["content"].count('"a"') == n
    values = [1, -2.5, "x\ny", None, True, [], {}, [[1], {"k": ["é", {}]}], 1e20]
    assert nested._parse_deep(json.dumps(values)) == values
    for broken in ('{"a"}', "[1,]", "[1 2]", "", '{"a":1,}', "[", "nul", '{1: 2}', '"a', "[1]]"):
        with pytest.raises(ValueError):
            nested._parse_deep(broken)
