"""Connection records as a keyed graph: cleaning, ordered merge, references across sheets, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.text import round_half_up, trimmed
from graticule.session import checkpointed

NUMERIC = r"^-?\d+(?:[.,]\d+)?$"
# Component kinds by letter prefix, all others are "other"; and the colours of the kinds.
KINDS = {
    "QF": "breaker", "QM": "breaker", "QS": "breaker",
    "KM": "relay", "KA": "relay", "K": "relay",
    "TS": "power", "PS": "power", "G": "power",
    "XT": "terminal", "X": "terminal",
    "FS": "fuse", "FU": "fuse",
    "SB": "switch", "SA": "switch", "S": "switch",
    "HL": "lamp", "H": "lamp",
    "AP": "plc", "PLC": "plc", "CPU": "plc",
    "M": "motor", "MOT": "motor",
}
COLORS = {"breaker": "#90EE90", "relay": "#87CEEB", "power": "#FFB6C1", "terminal": "#D3D3D3", "fuse": "#FFA500", "switch": "#FFFF00", "lamp": "#DDA0DD", "plc": "#00CED1", "motor": "#98FB98", "other": "#FFFFFF"}
#: Edges of a wire id up to which its references are joined up in one pass of a task; larger ones spread in rounds.
LOCAL_EDGES = 20_000

def numeric_coordinate(c: Column) -> Column:
    return trimmed(c).rlike(NUMERIC)


def is_reference(c: Column) -> Column:
    return F.lower(c).startswith("rimando")


def mark_reference(c: Column) -> Column:
    """Bare coordinates are references to another sheet."""
    return F.when(numeric_coordinate(c), F.concat(F.lit("rimando "), trimmed(c))).otherwise(c)


def normal_reference(c: Column) -> Column:
    """'rimando 105.1' points to sheet 105."""
    return F.regexp_replace(c, r"(?i)^(rimando\s+\d+)\.\d+$", "$1")


def unique_reference(c: Column, sheet: Column) -> Column:
    return F.when(is_reference(c), F.concat(normal_reference(c), F.lit("@"), F.coalesce(sheet.cast("string"), F.lit("null")))).otherwise(c)


def endpoint_class(c: Column) -> Column:
    return F.when(is_reference(c), "reference").when(c.rlike(r"(?i)^-?x\d+[.:]|^-?xt\d+[.:]"), "terminal").otherwise("component")


def dropped_id(c: Column) -> Column:
    """Ids of shielding and protective conductors."""
    return F.upper(trimmed(c)).startswith("W") | F.upper(trimmed(c)).isin("N", "PE", "PEN")


def clean_gauge(c: Column) -> Column:
    plain = F.replace(trimmed(c), F.lit(","), F.lit("."))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.when(F.lower(c).contains("mm") | trimmed(c).rlike(r"(?i)^\d+\s*x\s*\d+") | ((number > 0) & (number <= 70)), trimmed(c))


def clean_length(c: Column, number: bool = True) -> Column:
    """Numbers as they are, if finite; of texts those that read as a number above 0 and below a million, with either decimal sign."""
    if number:
        n = c.cast("double")
        return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)
    plain = F.regexp_replace(trimmed(c), "^([^,]*),", "$1.")
    n = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when((n > 0) & (n < 1e6), n)


def split_endpoint(c: Column) -> tuple[Column, Column]:
    """(component, pin): the part before the first separator and all after it; of a pin with letters only the number at its end."""
    t = trimmed(c)
    card = r"^(-?[A-Za-z]+\d+(?:-[A-Za-z]+\d+)*)(?:[.:/].*?[.:/]|[:.])X\d+[.:]([\d.]+)$"
    head, rest = F.regexp_extract(t, r"^([^.:]+)[.:]", 1), F.regexp_extract(t, r"(?s)^[^.:]+[.:](.*)$", 1)
    last = F.regexp_extract(rest, r"[.:/]([\d.]+)$", 1)
    pin = F.when(rest.rlike("[A-Za-z]") & (last != ""), last).otherwise(rest)
    on_card = t.rlike(card)
    return F.when(on_card, F.regexp_extract(t, card, 1)).when(head != "", head).otherwise(t), F.when(on_card, F.regexp_extract(t, card, 2)).when(head != "", pin).otherwise("")


def base_reference(c: Column) -> Column:
    bare = trimmed(F.regexp_replace(c, "^-", ""))
    base = F.regexp_extract(bare, r"^[A-Za-z]+\d+", 0)
    return F.when(base != "", base).otherwise(bare)


def component_kind(c: Column) -> Column:
    letters = F.regexp_replace(F.upper(F.regexp_replace(c, "^-", "")), r"\d.*$", "")
    lookup = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(lookup[letters], F.lit("other"))


def complete(df: DataFrame) -> DataFrame:
    """Wires with an id and two ends, of conductors that count, references made plain."""
    ok = (trimmed(F.col("id")) != "") & (trimmed(F.col("src")) != "") & (trimmed(F.col("dst")) != "") & ~dropped_id(F.col("id"))
    return df.filter(ok).withColumns({"src": unique_reference(mark_reference(F.col("src")), F.col("sheet")), "dst": unique_reference(mark_reference(F.col("dst")), F.col("sheet"))})


SCORED = ("cable", "gauge", "color", "length_mm", "terminal_a", "terminal_b", "note")


def filled(c: Column, kind: str) -> Column:
    """1 for a text that isn't blank and for a finite number, else 0."""
    if kind == "string":
        return F.when(trimmed(c) != "", 1).otherwise(0)
    return F.when(F.abs(c.cast("double")) < float("inf"), 1).otherwise(0)


def populated(df: DataFrame, columns: tuple[str, ...] = SCORED) -> Column:
    kinds = dict(df.dtypes)
    return sum((filled(F.col(c), kinds[c]) for c in columns if c in kinds), F.lit(0))


def merge_duplicates(df: DataFrame, order: str = "ord") -> DataFrame:
    """Wires of equal id and ends as one, folded in order: a later wire replaces the kept one if more of its fields are filled.

    Notes are joined, and the joined note counts as the kept wire's; all other columns follow the winner, ``order`` is the
    first one's. The fold depends on the order, so the wires of one connection (its repeats on the sheets) are folded in
    one array; equal orders are told apart by the other columns.
    """
    rest = [c for c in df.columns if c not in ("id", "src", "dst", order, "note")]
    base = populated(df, tuple(c for c in SCORED if c != "note"))
    row = F.struct(F.col(order).alias("_o"), base.alias("_s"), F.coalesce("note", F.lit("")).alias("note"), *rest)

    def step(acc: Column, x: Column) -> Column:
        score = lambda y: y["_s"] + F.when(trimmed(y["note"]) != "", 1).otherwise(0)
        better = score(x) > score(acc)
        note = F.concat_ws(" | ", F.when(acc["note"] != "", acc["note"]), F.when(x["note"] != "", x["note"]))
        pick = lambda c: F.when(better, x[c]).otherwise(acc[c]).alias(c)
        return F.struct(acc["_o"].alias("_o"), pick("_s"), note.alias("note"), *[pick(c) for c in rest])

    rows = df.groupBy("id", "src", "dst").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    out = rows.withColumn("_f", F.aggregate(F.slice("_r", F.lit(2), F.size("_r")), F.col("_r")[0], step))
    return out.select("id", "src", "dst", F.col("_f._o").alias(order), "_f.note", *[F.col("_f")[c].alias(c) for c in rest])


def marked_notes(df: DataFrame) -> DataFrame:
    """Bare coordinates as references, each with a note of its value."""
    note = lambda c: F.when(numeric_coordinate(F.col(c)), F.concat(F.lit("rimando/coord: "), trimmed(F.col(c))))
    return df.withColumns({"note": F.concat_ws(" | ", F.when(F.col("note") != "", F.col("note")), note("src"), note("dst")), "src": mark_reference(F.col("src")), "dst": mark_reference(F.col("dst"))})


def touching_references(df: DataFrame) -> DataFrame:
    """Of the pages of other panels only wires with a reference go on."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("rimando"))
    return df.filter(has("src") | has("dst"))


def with_panel_flag(own: DataFrame, other: DataFrame) -> DataFrame:
    """A panel's wires and those of other panels that touch a reference, each with the flag ``panel``."""
    return own.withColumn("panel", F.lit(True)).unionByName(touching_references(other).withColumn("panel", F.lit(False)))


def correct_blocks(df: DataFrame) -> DataFrame:
    """Endpoints whose terminal block misses its first digit, rewritten by ``suffix_corrections`` in one pass."""
    name = lambda c: F.upper(F.regexp_extract(c, r"(?i)^-?(XT\d+)", 1))
    ends = F.explode(F.array(F.struct(name("src").alias("name"), F.lit(0).alias("side")), F.struct(name("dst").alias("name"), F.lit(1).alias("side"))))
    names = df.select("ord", ends.alias("e")).filter("e.name <> ''").select("e.name", F.struct("ord", "e.side").alias("ord"))
    fixes = suffix_corrections(names)
    out = df
    for c in ("src", "dst"):
        out = out.withColumn("_n", name(c)).join(fixes.select(F.col("name").alias("_n"), "corrected"), "_n", "left")
        out = out.withColumn(c, F.when(F.col("corrected").isNull(), F.col(c)).otherwise(F.concat(F.regexp_extract(c, "^-?", 0), "corrected", F.regexp_extract(c, r"(?i)^-?XT\d+(.*)$", 1)))).drop("_n", "corrected")
    return out.select(*df.columns)


def suffix_corrections(names: DataFrame) -> DataFrame:
    """(name, corrected): terminal blocks whose name another name repeats with one digit before it; the first such."""
    digits = F.regexp_extract("name", r"^XT(\d+)$", 1)
    n = names.groupBy("name").agg(F.min("ord").alias("ord")).withColumn("digits", digits).filter("digits <> ''")
    longer = n.select(F.col("name").alias("corrected"), F.col("ord").alias("lord"), F.expr("substring(digits, 2)").alias("digits")).filter("digits <> ''")
    return n.join(longer, "digits").groupBy("name").agg(F.min_by("corrected", F.struct("lord", "corrected")).alias("corrected"))


def reference_edges(wires: DataFrame) -> DataFrame:
    """(id, a, b): links between reference nodes, by wires and by references that name each other's sheet."""
    ends = wires.select("id", F.explode(F.array("src", "dst")).alias("n")).filter(is_reference(F.col("n"))).distinct()
    at = ends.select("id", "n", F.regexp_extract("n", r"(?i)rimando\s+(-?\d+)@", 1).alias("to"), F.regexp_extract("n", r"@(-?\d+)$", 1).alias("on")).filter("`to` <> '' and `on` <> ''")
    x, y = at.alias("x"), at.alias("y")
    back = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.to") == F.col("y.on")) & (F.col("x.on") == F.col("y.to"))).select("x.id", F.col("x.n").alias("a"), F.col("y.n").alias("b")).filter("a <> b")
    direct = wires.filter(is_reference(F.col("src")) & is_reference(F.col("dst"))).select("id", F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b")
    return back.unionByName(direct).unionByName(direct.select("id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def reference_groups(wires: DataFrame) -> DataFrame:
    """(id, n, root) of the references that have a neighbour: connected ones have the least name among them as root.

    The references of one wire id are few, so the edges of an id meet in one task, which joins them up id by id. An id with
    more than ``LOCAL_EDGES`` edges is spread over all tasks instead, in rounds.
    """
    edges = checkpointed(reference_edges(wires))
    large = edges.groupBy("id").count().filter(F.col("count") > LOCAL_EDGES).select("id")
    if large.isEmpty():
        return _local_groups(edges)
    large = checkpointed(large)
    return _local_groups(edges.join(large, "id", "left_anti")).unionByName(spread_groups(edges.join(large, "id", "left_semi")))


def _local_groups(edges: DataFrame) -> DataFrame:
    """Groups by union and find over edges that are sorted by id, one id in memory at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, up = None, {}

        def find(n: str) -> str:
            while up[n] != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if i != own:
                    out += [(own, n, find(n)) for n in up]
                    own, up = i, {}
                x, y = find(up.setdefault(a, a)), find(up.setdefault(b, b))
                up[max(x, y)] = min(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["id", "n", "root"])
        rest = [(own, n, find(n)) for n in up]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rest], pa.string()) for k in range(3)], names=["id", "n", "root"])

    once = edges.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return once.repartition("id").sortWithinPartitions("id").mapInArrow(rows, "id string, n string, root string")


def spread_groups(edges: DataFrame) -> DataFrame:
    """Groups by spreading the least name until nothing changes; two steps a round."""
    roots = checkpointed(edges.select("id", F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("root", F.col("n")))
    while True:
        new = checkpointed(_spread(_spread(roots.select("id", "n", "root", F.lit(False).alias("moved")), edges), edges))
        roots = new.select("id", "n", "root")
        if not new.filter("moved").limit(1).count():
            return roots


def _spread(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """One step: each reference takes the least name among its own and its neighbours'."""
    near = edges.join(roots.select("id", F.col("n").alias("b"), "root"), ["id", "b"]).groupBy("id", F.col("a").alias("n")).agg(F.min("root").alias("other"))
    return roots.join(near, ["id", "n"], "left").select("id", "n", F.least("root", F.coalesce("other", "root")).alias("root"), (F.col("moved") | F.coalesce(F.col("other") < F.col("root"), F.lit(False))).alias("moved"))


def resolve(wires: DataFrame) -> DataFrame:
    """(id, a, b) with a < b: real ends that are connected, directly or through references."""
    wires = checkpointed(wires.select("id", "src", "dst"))  # read for the direct pairs, the references and their edges
    direct = wires.filter(~is_reference(F.col("src")) & ~is_reference(F.col("dst"))).select("id", F.col("src").alias("a"), F.col("dst").alias("b"))
    touch = wires.select("id", F.explode(F.array(F.struct(F.col("src").alias("real"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("real"), F.col("src").alias("n")))).alias("t")).select("id", "t.*").filter(~is_reference(F.col("real")) & is_reference(F.col("n")))
    grouped = touch.join(reference_groups(wires), ["id", "n"], "left")
    seen = grouped.select("id", F.coalesce("root", "n").alias("root"), "real").distinct()
    via = seen.alias("x").join(seen.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.root") == F.col("y.root")) & (F.col("x.real") < F.col("y.real"))).select("x.id", F.col("x.real").alias("a"), F.col("y.real").alias("b"))
    pairs = direct.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    return pairs.unionByName(via).distinct()


def new_connections(wires: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved connections that no complete wire states in either direction."""
    real = wires.filter(~is_reference(F.col("src")) & ~is_reference(F.col("dst"))).select("id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return resolved.join(real, ["id", "a", "b"], "left_anti")


def unresolved(wires: DataFrame, resolved: DataFrame) -> DataFrame:
    """Wires with a reference whose id has no resolved connection."""
    return wires.filter(is_reference(F.col("src")) | is_reference(F.col("dst"))).join(resolved.select("id").distinct(), "id", "left_anti")


def cut_list(df: DataFrame) -> DataFrame:
    """Lengths and numbers by cable, gauge and colour; blank and missing are one, lengths of 0 don't count."""
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")).alias(c)
    rows = df.withColumn("_l", clean_length(F.col("length_mm"), dict(df.dtypes)["length_mm"] != "string")).filter("_l <> 0")
    rows = rows.select(blank("cable"), F.coalesce(clean_gauge(F.col("gauge")), F.lit("")).alias("gauge"), blank("color"), "_l")
    return rows.groupBy("cable", "gauge", "color").agg(round_half_up(F.sum("_l")).alias("total_mm"), F.count("*").alias("pieces"))


def merge_components(df: DataFrame) -> DataFrame:
    """Components by reference: first description, summed quantity, all wires once in order of arrival, first page."""
    own = df.filter(trimmed(F.coalesce("ref", F.lit(""))) != "")
    head = own.groupBy("ref").agg(F.min_by("description", "ord").alias("description"), F.sum("quantity").alias("quantity"), F.min_by("page", "ord").alias("page"))
    # each wire once per component before anything is gathered
    once = own.select("ref", "ord", F.posexplode("wires").alias("i", "w")).select("ref", "ord", "i", trimmed(F.col("w")).alias("w")).filter("w <> ''").groupBy("ref", "w").agg(F.min(F.struct("ord", "i")).alias("at"))
    listed = once.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), ",").alias("wires"))
    return head.join(listed, "ref", "left").withColumn("wires", F.coalesce("wires", F.lit("")))


def labels(df: DataFrame) -> DataFrame:
    """Up to two label rows per wire, one for each end that isn't blank."""
    ends = F.array(F.struct(F.lit("A").alias("side"), F.col("src").alias("endpoint")), F.struct(F.lit("B").alias("side"), F.col("dst").alias("endpoint")))
    return df.select("id", F.explode(F.filter(ends, lambda e: trimmed(F.coalesce(e["endpoint"], F.lit(""))) != "")).alias("e")).select("id", "e.side", "e.endpoint")


def schema_nodes(pairs: DataFrame) -> DataFrame:
    node = base_reference(F.col("n"))
    return pairs.select(F.explode(F.array("a", "b")).alias("n")).select(node.alias("node")).distinct().select("node", component_kind(F.col("node")).alias("kind"))


def schema_edges(pairs: DataFrame) -> DataFrame:
    end = lambda c: base_reference(F.col(c))
    return pairs.select(end("a").alias("source"), end("b").alias("target"), F.col("id").alias("wire_id"))


def graph_nodes(wires: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(node, kind, page, label, color): each component once, with the page of the first wire that names it.

    components: ref, description, ord; the last description that isn't empty, cut at 30 characters, follows the label.
    """
    end = lambda c, side: F.struct(base_reference(F.col(c)).alias("node"), F.lit(side).alias("side"))
    ends = wires.select("ord", "page", F.explode(F.array(end("src", 0), end("dst", 1))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.min_by("page", F.struct("ord", "e.side")).alias("page")).withColumn("kind", component_kind(F.col("node")))
    colors = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    label = F.col("node")
    if components is not None:
        told = components.filter((F.col("ref") != "") & (F.col("description") != "")).groupBy(base_reference(F.col("ref")).alias("node")).agg(F.max_by("description", "ord").alias("_d"))
        nodes = nodes.join(told, "node", "left")
        label = F.when(F.col("_d").isNull(), label).otherwise(F.concat(label, F.lit("\\n"), F.substring("_d", 1, 30)))
    return nodes.select("node", "kind", "page", label.alias("label"), colors[F.col("kind")].alias("color"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """Graph description lines of the edges, each once."""
    return edges.dropDuplicates(["source", "target", "wire_id"]).select(F.concat(F.lit('  "'), "source", F.lit('" -> "'), "target", F.lit('" [label="'), "wire_id", F.lit('"];')).alias("line"))


def dot_node_lines(nodes: DataFrame) -> DataFrame:
    """Graph description lines of the nodes."""
    label = F.replace(F.col("label"), F.lit('"'), F.lit('\\"'))
    return nodes.select(F.concat(F.lit('  "'), "node", F.lit('" [label="'), label, F.lit('", fillcolor="'), "color", F.lit('"];')).alias("line"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): the graph for a viewer, an object per row; edges stay as often as they are."""
    n = F.to_json(F.struct(F.col("node").alias("id"), F.col("kind").alias("type"), F.replace(F.col("label"), F.lit("\\n"), F.lit("\n")).alias("label"), "color"))
    e = F.to_json(F.struct("source", "target", F.col("wire_id").alias("wireId"), F.when(F.col("wire_id") != "", F.concat(F.lit("Filo "), "wire_id")).otherwise("").alias("label")))
    return nodes.select(F.lit("node").alias("part"), n.alias("json")).unionByName(edges.select(F.lit("edge").alias("part"), e.alias("json")))


# ---- sheets of the wire report; an empty one has one blank row

def _or_blank(df: DataFrame, **values: str) -> DataFrame:
    """The rows, or one blank row (with these values) if there is none."""
    one = df.sparkSession.range(1).select(*[F.lit(values.get(c, "")).cast(t).alias(c) if t == "string" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(one.join(df.limit(1).select(F.lit(1).alias("_x")), how="left_anti", on=F.lit(True)))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def wire_sheet(wires: DataFrame) -> DataFrame:
    """The wire list: both ends as component and pin, apart and in one cell."""
    (fc, fp), (tc, tp) = split_endpoint(_text("src")), split_endpoint(_text("dst"))
    cell = lambda c, p: F.when(p != "", F.concat(c, F.lit(" | "), p)).otherwise(c)
    more = [_text(c).alias(a) for c, a in (("cable", "cavo"), ("gauge", "sezione"), ("color", "colore"), ("length_mm", "lunghezza_mm"), ("terminal_a", "terminale_a"), ("terminal_b", "terminale_b"), ("page", "pagina"), ("note", "note")) if c in wires.columns]
    return _or_blank(wires.select(_text("id").alias("id"), fc.alias("da"), fp.alias("pin_da"), cell(fc, fp).alias("da_inizio"), tc.alias("a"), tp.alias("pin_a"), cell(tc, tp).alias("a_fine"), *more))


def component_sheet(components: DataFrame) -> DataFrame:
    names = (("ref", "rif"), ("description", "descrizione"), ("quantity", "quantita"), ("manufacturer", "produttore"), ("part_number", "codice"), ("location", "posizione"), ("wires", "fili_associati"), ("page", "pagina"), ("note", "note"))
    return _or_blank(components.select(*[_text(c).alias(a) for c, a in names if c in components.columns]))


def label_sheet(wires: DataFrame) -> DataFrame:
    """A row for each end of each wire, with its component and pin."""
    ends = F.array(F.struct(F.lit("A").alias("estremita"), _text("src").alias("sigla")), F.struct(F.lit("B").alias("estremita"), _text("dst").alias("sigla")))
    rows = wires.select(_text("id").alias("id_filo"), _text("note").alias("note"), F.explode(F.filter(ends, lambda e: e["sigla"] != "")).alias("e")).select("id_filo", "note", "e.*")
    c, p = split_endpoint(F.col("sigla"))
    return _or_blank(rows.select(c.alias("componente"), p.alias("pin"), "sigla", "id_filo", "estremita", "note"), note="Nessun filo estratto")


def text_sheet(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, riga, testo): the numbered lines of a text."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("riga", "testo")).withColumn("riga", F.col("riga") + 1)


def split_suffix(df: DataFrame, column: str = "ref") -> DataFrame:
    """References with a terminal behind a separator lose it; it becomes a note."""
    pattern = r"^(-?[A-Za-z0-9]+)[:\\/](.*)$"
    split = F.col(column).rlike(pattern)
    note = F.concat_ws(" | ", F.when(F.col("note") != "", F.col("note")), F.when(split, F.concat(F.lit("terminale/suffisso: "), trimmed(F.regexp_extract(column, pattern, 2)))))
    return df.withColumns({"note": note, column: F.when(split, F.regexp_extract(column, pattern, 1)).otherwise(F.col(column))})


def page_order(name: Column) -> list[Column]:
    """Page images by the number at the end of their names, those without one first, then by name."""
    return [F.coalesce(F.regexp_extract(name, r"-(\d+)\.png$", 1).try_cast("bigint"), F.lit(0).cast("bigint")).asc(), name.asc()]


def panel_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s+\-]", ""))


def panel_pages(df: DataFrame, panel: str, column: str = "location") -> DataFrame:
    key = panel.upper().replace(" ", "").replace("+", "").replace("-", "")
    return df.filter((panel_key(F.col(column)) == key) & F.lit(bool(key)))


def panel_wires(wires: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Wires of which either end is among the panel's endpoints (column n, lower case)."""
    low = wires.withColumns({"_a": F.lower("src"), "_b": F.lower("dst")})
    ends = endpoints.select("n").distinct()
    a = low.join(ends.withColumnRenamed("n", "_a"), "_a", "left_semi")
    b = low.join(ends.withColumnRenamed("n", "_a"), "_a", "left_anti").join(ends.withColumnRenamed("n", "_b"), "_b", "left_semi")
    return a.select(*wires.columns).unionByName(b.select(*wires.columns))


def parse_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """'id from > to' lines of plain text, in order; every line is read."""
    pattern = r"^(\S+)\s+(\S+)\s*(?:->|–|>|-)\s*(\S+)"
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "raw")).withColumn("raw", F.trim("raw")).filter(F.col("raw").rlike(pattern))
    return lines.select(key, "pos", *[F.regexp_extract("raw", pattern, i).alias(c) for i, c in enumerate(("wire_id", "src", "dst"), 1)])


def tile_rects(df: DataFrame, grid: int = 2, overlap: float = 0.06) -> DataFrame:
    """(row, col, x, y, w, h) of a grid of tiles over width and height, overlapping on inner edges only."""
    g = max(2, min(4, grid))
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(g) for c in range(g)])
    t = df.select("*", F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c")
    def span(size: str, at: str) -> tuple[Column, Column]:
        step = F.col(size) / g
        lap = F.floor(step * overlap)
        low = F.floor(F.col(at) * step) - F.when(F.col(at) > 0, lap).otherwise(0)
        high = F.when(F.col(at) == g - 1, F.col(size)).otherwise(F.floor((F.col(at) + 1) * step) + lap)
        return low.cast("int"), (high - low).cast("int")
    (x, w), (y, h) = span("width", "col"), span("height", "row")
    return t.withColumns({"x": x, "y": y, "w": w, "h": h})
