"""Deeply nested records as related flat tables (problem 2).

Two kinds of input share one result, tables linked by (record, parent path, ordinal):

* typed columns (structs, arrays, maps): the schema is known, each array or map level is exploded by Catalyst into its
  own child table;
* JSON texts whose shape varies from record to record: one pass infers the merged schema, i.e. at which key paths any
  record holds a list, a second pass explodes every level, reading a lone object, an encoded list or a null at such a path
  as the list that it stands for.

Both passes are maps over rows; only the distinct list paths, part of the schema, are shuffled and collected. Surrogate
keys are hashes of (record id, path), equal in every run.

Defined cases: null, empty and unreadable texts give no rows; a byte-order mark before the text is not part of it; a text
that is itself a JSON string is read again, as often as it was encoded; records may be nested to any depth, as every walk
has its own stack; null elements are counted in the ordinals and give no rows; repeated
records give their rows once per copy (callers that want sets use ``distinct``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "record_id string, parent_key string, row_key string, table_path string, parent_path string, child_path string, ordinal int, content string"


SPACE = re.compile(r"[ \t\r\n]*")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
#: The words of JSON, and those that its common writers add.
WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse(text: str):
    """The value of a JSON text of any depth: the built-in parser, or one with its own stack where that runs out of calls."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    stack: list[tuple[list | dict, str | None]] = []  # open lists and objects, each with the name that waits for a value
    at, end = SPACE.match(text).end(), len(text)
    while True:
        # a value begins at ``at``
        c = text[at : at + 1]
        if c and c in "[{":
            new = [] if c == "[" else {}
            at = SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                value, at = new, at + 1
            else:
                name = None
                if c == "{":
                    name, at = _name(text, at)
                stack.append((new, name))
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif (word := next((w for w in WORDS if text.startswith(w, at)), None)) is not None:
            value, at = WORDS[word], at + len(word)
        elif m := NUMBER.match(text, at):
            value, at = (float if m[1] or m[2] else int)(m.group()), m.end()
        else:
            raise ValueError("no value")
        # the value ends; it may end what holds it
        while True:
            at = SPACE.match(text, at).end()
            if not stack:
                if at < end:
                    raise ValueError("text after the value")
                return value
            holder, name = stack[-1]
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            mark = text[at : at + 1]
            if mark == ",":
                at = SPACE.match(text, at + 1).end()
                if isinstance(holder, dict):
                    name, at = _name(text, at)
                    stack[-1] = (holder, name)
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("no end")
            value, at = stack.pop()[0], at + 1


def _name(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("no name")
    name, at = scanstring(text, at + 1, True)
    at = SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no value of a name")
    return name, SPACE.match(text, at + 1).end()


def write(value) -> str:
    """JSON of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [("v", value)]
    while todo:
        kind, x = todo.pop()
        if kind == "t":
            out.append(x)
        elif isinstance(x, dict) and x:
            parts = [part for i, (k, v) in enumerate(x.items()) for part in (("t", (", " if i else "{") + json.dumps(k, ensure_ascii=False) + ": "), ("v", v))]
            todo += reversed([*parts, ("t", "}")])
        elif isinstance(x, list) and x:
            parts = [part for i, v in enumerate(x) for part in (("t", ", " if i else "["), ("v", v))]
            todo += reversed([*parts, ("t", "]")])
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def read_json(text: str | None):
    """The value of a JSON text, or None; a leading byte-order mark is skipped, a text that was encoded again is decoded as often."""
    while text is not None:
        try:
            value = parse(text.lstrip("\ufeff \t\r\n"))
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
        text = value
    return None


def bare(shape: str) -> str:
    """A key path without the marks of lists at its end."""
    while shape.endswith("[]"):
        shape = shape[:-2]
    return shape


def _encoded(value):
    """What a string holds if it is an encoded list or object, else None."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
        inner = read_json(value)
        return inner if isinstance(inner, (list, dict)) else None
    return None


def list_paths(value) -> Iterator[str]:
    """Key paths, without indices, at which this value holds a list; '[]' at the end stands for a list within a list."""
    todo = [("", value)]
    while todo:
        path, v = todo.pop()
        inner = _encoded(v)
        if isinstance(inner, dict) or isinstance(inner, list) and any(isinstance(x, dict) for x in inner):
            v = inner
        if isinstance(v, list):
            yield path
            todo += [(path + "[]", x) for x in v]
        elif isinstance(v, dict):
            base = bare(path)
            todo += [(f"{base}.{k}" if base else k, x) for k, x in v.items()]


def explode_value(value, lists: set[str]) -> Iterator[tuple[str, str, str, int, dict]]:
    """(table path, parent path, path, ordinal, object) of each object that is an element of a list, outermost first."""
    todo = [("", "", "", value)]
    while todo:
        shape, path, parent, v = todo.pop()
        if shape in lists and not isinstance(v, list):
            inner = _encoded(v)
            v = inner if isinstance(inner, list) else [inner if inner is not None else v] if isinstance(inner if inner is not None else v, dict) else []
        if isinstance(v, list):
            for i, x in reversed(list(enumerate(v))):
                at = f"{path}[{i}]"
                if isinstance(x, dict) and shape + "[]" not in lists:
                    yield shape, parent, at, i, x
                    todo.append((shape + "[]", at, at, x))
                elif isinstance(x, (list, dict, str)):
                    todo.append((shape + "[]", at, parent, x))
        elif isinstance(v, dict):
            base = bare(shape)
            todo += [(f"{base}.{k}" if base else k, f"{path}.{k}" if path else k, parent, x) for k, x in reversed(list(v.items())) if x is not None]


def infer_lists(df: DataFrame, column: str) -> set[str]:
    """The merged schema's list paths over all records; their number is that of the schema's keys, not of the rows."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            new = {p for t in b.column(0).to_pylist() if (v := read_json(t)) is not None for p in list_paths(v)} - seen
            seen |= new
            yield pa.RecordBatch.from_pydict({"path": pa.array(sorted(new), pa.string())})

    return {r[0] for r in df.select(F.col(column).cast("string")).mapInArrow(paths, "path string").distinct().collect()}


def flatten_json(df: DataFrame, key: str, column: str, lists: set[str] | None = None) -> DataFrame:
    """One row per object that is an element of a list, with its own and its parent's surrogate key; see ``ROWS``.

    ``content`` holds the object's scalars and plain objects as JSON, without the lists that became child tables.
    """
    found = frozenset(infer_lists(df, column) if lists is None else lists)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value = read_json(text)
                if value is not None:
                    out += [(rid, s, p, c, i, write(own_fields(o, s, found))) for s, p, c, i, o in explode_value(value, found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=["record_id", "table_path", "parent_path", "child_path", "ordinal", "content"])

    flat = df.select(F.col(key).cast("string"), F.col(column).cast("string")).mapInArrow(rows, "record_id string, table_path string, parent_path string, child_path string, ordinal int, content string")
    return flat.select("record_id", surrogate("record_id", "parent_path").alias("parent_key"), surrogate("record_id", "child_path").alias("row_key"), "table_path", "parent_path", "child_path", "ordinal", "content")


def own_fields(obj: dict, shape: str, lists: frozenset[str]) -> dict:
    """An object without the lists that became child tables, at any depth."""
    out: dict = {}
    todo = [(obj, bare(shape), out)]
    while todo:
        own, base, to = todo.pop()
        for k, v in own.items():
            path = f"{base}.{k}" if base else k
            if path in lists:
                continue
            if isinstance(v, dict):
                to[k] = {}
                todo.append((v, path, to[k]))
            else:
                to[k] = v
    return out


def surrogate(record: str, path: str):
    return F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(record), F.lit("\u0000")), F.col(path)), 256).substr(1, 32)


def child_table(flat: DataFrame, table_path: str) -> DataFrame:
    """One child table of ``flatten_json`` in typed columns; its schema is inferred from all its rows."""
    own = flat.filter(F.col("table_path") == table_path)
    shape = own.agg(F.schema_of_variant_agg(F.parse_json("content"))).first()[0]
    ddl = (shape or "OBJECT<>").replace("OBJECT<", "STRUCT<")
    if ddl == "STRUCT<>" or ddl == "VOID":
        return own.drop("content")
    return own.select("record_id", "parent_key", "row_key", "parent_path", "child_path", "ordinal", F.from_json("content", ddl).alias("_o")).select("*", "_o.*").drop("_o")


def flatten_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The array elements and map entries below typed columns, one row each; nested levels by recursion over the schema.

    Null elements of arrays give no rows; a map entry stands even where its value is null.
    """
    parts: list[DataFrame] = []

    def walk(rows: DataFrame, kind: T.DataType, parent: bool) -> None:
        # rows: record_id, _parent, _path, _v
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                dot = F.concat("_path", F.when(F.col("_path") == "", "").otherwise("."), F.lit(f.name))
                walk(rows.select("record_id", "_parent", dot.alias("_path"), F.col("_v").getField(f.name).alias("_v")), f.dataType, parent)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            if isinstance(kind, T.ArrayType):
                level = rows.select("record_id", "_parent", F.col("_path").alias("_table"), F.posexplode("_v").alias("_i", "_v")).filter(F.col("_v").isNotNull()).withColumn("_path", F.concat("_table", F.lit("["), F.col("_i").cast("string"), F.lit("]")))
                inner = kind.elementType
            else:
                level = rows.select("record_id", "_parent", F.col("_path").alias("_table"), F.posexplode("_v").alias("_i", "_k", "_v")).withColumn("_path", F.concat("_table", F.lit("."), F.col("_k").cast("string"))).drop("_k")
                inner = kind.valueType
            text = F.to_json(F.struct("_v")) if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)) else F.col("_v").cast("string")
            parts.append(level.select("record_id", surrogate("record_id", "_parent").alias("parent_key"), surrogate("record_id", "_path").alias("row_key"), F.col("_table").alias("table_path"), F.col("_parent").alias("parent_path"), F.col("_path").alias("child_path"), F.col("_i").alias("ordinal"), text.alias("content")))
            walk(level.select("record_id", (F.col("_path") if isinstance(inner, T.StructType) else F.col("_parent")).alias("_parent"), "_path", "_v"), inner, True)

    for c in columns:
        walk(df.select(F.col(key).cast("string").alias("record_id"), F.lit("").alias("_parent"), F.lit(c).alias("_path"), F.col(c).alias("_v")), df.schema[c].dataType, False)
    if not parts:
        return df.sparkSession.createDataFrame([], ROWS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
