"""General operators: worked cases and literal models."""

import random

import pytest
from pyspark.sql import functions as F

from graticule.functions import text as tx
from graticule.operators import docs, reconcile, registry, store, wires


def values(spark, xs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_normalised_keys(spark):
    xs = ["  DSA-01_A ", "__x  y--", "A.B", "-", " : ", None, "a b"]
    assert values(spark, xs, tx.normalized) == ["dsa-01-a", "x-y", "a.b", "", ":", "", "a-b"]
    off = tx.Settings(normalize_dashes=False)
    assert values(spark, xs[:4], lambda c: tx.normalized(c, off)) == ["dsa-01_a", "__x y--", "a.b", "-"]
    assert values(spark, ["dsa-01-a", ":", "a.b"], tx.tokens) == [["dsa", "01", "a"], [], ["a", "b"]]


def test_rounding_and_cells(spark):
    assert values(spark, [-2.5, 2.5, 0.4], tx.round_half_up, "double") == [-2, 3, 0]
    assert values(spark, [0, None, 5], lambda c: tx.csv_cell(c, "int"), "int") == ['""', '""', "5"]
    assert values(spark, ['a"b', ""], lambda c: tx.csv_cell(c, "string")) == ['"a\\"b"', '""']


def test_reconcile_case(spark):
    t = spark.createDataFrame([("PES-01-A", "Relazione generale", "t1", 0), ("PES 02 B", "Pianta piano terra", "t1", 1), ("STRUTTURALE", "", "t1", 2), ("pes_01_a", "dup", "t2", 3), ("PES-03-C", "Sezione", "t2", 4)], "code string, description string, source string, ord int")
    f = spark.createDataFrame([("d1", "pes_01_a", "Relazione generale"), ("d2", "PES-02-X", "Altro"), ("d3", "PES-99-Z", "Extra"), ("d4", "PES 01 A", "Relazione")], "document_id string, code string, description string")
    e = reconcile.reconcile(t, f, prefix="PES")
    got = {r["primary_key"]: (r["status"], r["document_id"], r["score"]) for r in e.collect()}
    assert got == {"pes-01-a": ("matched", "d4", 1.0), "pes-02-b": ("partial", "d2", 0.5), "pes-03-c": ("missing_from_folder", None, None), "pes-99-z": ("missing_from_table", "d3", None)}
    counts = reconcile.summary(e).first().asDict()
    assert {k: counts[k] for k in ("matched", "partial", "missing_from_folder", "missing_from_table", "desc_mismatch", "score_exact", "score_low", "desc_medium", "desc_low")} == {"matched": 1, "partial": 1, "missing_from_folder": 1, "missing_from_table": 1, "desc_mismatch": 1, "score_exact": 1, "score_low": 1, "desc_medium": 1, "desc_low": 1}
    assert {r["source"]: r["entries"] for r in reconcile.source_stats(t, e).collect()} == {"t1": 3, "t2": 2}
    none = reconcile.reconcile(t.limit(0), f.limit(0))
    assert none.count() == 0


def test_best_match_is_the_nested_loop(spark):
    random.seed(2)
    word = lambda: "-".join(random.choice("abcdefg") for _ in range(random.randint(1, 4)))
    left, right = sorted({word() for _ in range(60)} | {":"}), sorted({word() for _ in range(60)} | {";"})
    random.shuffle(right)
    got = {r[0]: (r[1], round(r[2], 9)) for r in reconcile.best_match(spark.createDataFrame([(x,) for x in left], "t_key string"), spark.createDataFrame([(x, i) for i, x in enumerate(right)], "f_key string, pos int"), 0.5).collect()}
    split = lambda x: {y for y in x.replace(":", "-").replace(";", "-").split("-") if y}
    want = {}
    for a in left:
        best = 0.0
        for b in right:
            x, y = split(a), split(b)
            s = 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y)
            if s >= 0.5 and s > best:
                best, want[a] = s, (b, round(s, 9))
    assert got == want
    with pytest.raises(ValueError):
        reconcile.best_match(spark.createDataFrame([("a",)], "t_key string"), spark.createDataFrame([("a", 0)], "f_key string, pos int"), 0)


def test_endpoints(spark):
    xs = ["QM102.13", "AP602-EN101:X1.21", "AP601-ID101.X1:21", "XT3.24.1", "-QM102.13", "XT1.1102", "KM131.2", "AP601-OD102.DO-01/X1.11", "XT1", "QM1.KM838.11"]
    want = [("QM102", "13"), ("AP602-EN101", "21"), ("AP601-ID101", "21"), ("XT3", "24.1"), ("-QM102", "13"), ("XT1", "1102"), ("KM131", "2"), ("AP601-OD102", "11"), ("XT1", ""), ("QM1", "11")]
    got = values(spark, xs, lambda c: F.struct(*wires.split_endpoint(c)))
    assert [tuple(r) for r in got] == want
    assert values(spark, ["rimando 105.1", "rimando 105,1", "x"], wires.normal_reference) == ["rimando 105", "rimando 105,1", "x"]
    assert values(spark, ["2,5", "70", "160.2", "3x1.5", "1.5mm2"], wires.clean_gauge) == ["2,5", "70", None, "3x1.5", "1.5mm2"]
    assert values(spark, ["W12", "pe", "L1"], wires.dropped_id) == [True, True, False]


WIRE = "id string, src string, dst string, sheet int"


def links(spark, rows):
    return {tuple(r) for r in wires.resolve(wires.complete(spark.createDataFrame(rows, WIRE))).collect()}


def test_wire_resolution(spark):
    a, b = ("24", "QM102.13", "rimando 108.8", 105), ("24", "rimando 105.1", "KM131.2", 108)
    assert links(spark, [a, b]) == {("24", "KM131.2", "QM102.13")}
    assert links(spark, [a]) == set()
    assert links(spark, [("1", "A", "B", 1), ("1", "B", "C", 1)]) == {("1", "A", "B"), ("1", "B", "C")}
    assert links(spark, [("1", "A", "rimando 105", None), ("1", "B", "rimando 105", None)]) == {("1", "A", "B")}
    assert links(spark, []) == set()


def test_wires_like_breadth_first_search(spark):
    random.seed(5)
    node = lambda: random.choice(["A", "B", "C", "D", "rimando 1", "rimando 2", "rimando 3"])
    rows = [(str(i), node(), node(), random.randint(1, 3)) for i in range(12) for _ in range(6)]
    want = set()
    for i in {r[0] for r in rows}:
        edges, real = {}, set()
        own = [(s if s[0] != "r" else f"{s}@{h}", d if d[0] != "r" else f"{d}@{h}") for w, s, d, h in rows if w == i]
        nodes = {x for e in own for x in e}
        for x, y in own:
            edges.setdefault(x, set()).add(y)
            edges.setdefault(y, set()).add(x)
        refs = [n for n in nodes if n[0] == "r"]
        for x in refs:
            for y in refs:
                if x != y and x.split("@")[0].split()[1] == y.split("@")[1] and y.split("@")[0].split()[1] == x.split("@")[1]:
                    edges.setdefault(x, set()).add(y)
        real = nodes - set(refs)
        for start in real:
            seen, todo = {start}, [start]
            while todo:
                for y in edges.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        if y in real:
                            want.add((i, *sorted((start, y))))
                        else:
                            todo.append(y)
    assert links(spark, rows) == want


def test_ordered_merge_is_the_literal_fold(spark):
    random.seed(3)
    rows = [("1", "a", "b", i, *[random.choice([None, "", "v", " "]) for _ in range(3)], random.choice([None, f"n{i}"])) for i in range(30)]
    acc, score = None, lambda w: sum(bool(w[k] and w[k].strip()) for k in (4, 5, 6, 7))
    for w in map(list, rows):
        if acc is None:
            acc = w
            continue
        notes = [x.strip() for x in (acc[7], w[7]) if x and x.strip()]
        keep = w if score(w) > score(acc) else acc
        acc = [*acc[:4], *keep[4:7], " | ".join(notes)]
    got = wires.merge_duplicates(spark.createDataFrame(rows, "id string, src string, dst string, ord int, cable string, gauge string, color string, note string")).first()
    assert (got["cable"], got["gauge"], got["color"], got["note"]) == tuple(acc[4:])


def test_tiles_and_corrections(spark):
    r = wires.tile_rects(spark.createDataFrame([(1000, 800)], "width int, height int")).select("x", "y", "w", "h").collect()
    assert {tuple(x) for x in r} == {(0, 0, 530, 424), (470, 0, 530, 424), (0, 376, 530, 424), (470, 376, 530, 424)}
    fix = lambda names: {tuple(x) for x in wires.suffix_corrections(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")).collect()}
    assert fix(["XT2", "XT12"]) == {("XT2", "XT12")} and fix(["XT2", "XT112"]) == set()


def test_store(spark):
    xs = ['{"a": {"b": 1}}', '{"a": {"b": "1"}}', '{"a": {}}', "null", "x", None]
    assert values(spark, xs, lambda c: store.equals(c, "a.b", 1)) == [True, False, False, False, False, False]
    assert values(spark, xs, lambda c: store.equals(c, "a.b", "1"))[:2] == [False, True]
    names = spark.createDataFrame([("report.pdf", i) for i in range(3)] + [("a", 9)], "name string, i int")
    assert sorted(r[0] for r in store.unique_names(names, "name", ["i"]).select("unique_name").collect()) == ["a", "report(1).pdf", "report(2).pdf", "report.pdf"]
    assert [tuple(r) for r in store.envelope(spark.range(7), 5, 5).collect()] == [(2, 2, False, 7)]


def test_registry_and_documents(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    c = spark.createDataFrame([(2, "B", None), (3, "C", "z")], "id int, v string, w string")
    assert sorted(map(tuple, registry.insert_new(t, c, "id").collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "C", "z")]
    assert sorted(map(tuple, registry.update(t, c, "id", ["v"], ["w"]).collect())) == [(1, "a", "x"), (2, "B", None)]
    d = spark.createDataFrame([("k", ["s", "clause one here"], "one")], "k string, s array<string>, clause string")
    got = docs.context(d.selectExpr("k", "0 as pos", "clause"), d.select("k", F.posexplode("s").alias("ord", "section")), "k").first()
    assert got["section_ord"] == 1 and got["found"]
    h = spark.createDataFrame([([("From", "a"), ("FROM", "b")],)], "h array<struct<name: string, value: string>>")
    assert h.select(docs.header_map(F.col("h"))).first()[0] == {"from": "b"}


def test_context_of_every_line(spark, tmp_path):
    from graticule.plans import queries

    texts = {1: "a\nb\n\nc\n\nb c", 2: "x", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i, next(j for j, part in enumerate(t.split("\n\n")) if line in part)) for d, t in texts.items() if t for i, line in enumerate(t.split("\n")) if line}
    assert {(r["doc_id"], r["pos"], r["section_ord"]) for r in queries.clause_context(spark, str(tmp_path)).collect()} == want
