"""Reconciliation by field mappings: several list tables against a folder, every mapped field compared."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.text import Settings, code_prefix, compose, jaccard, normalized, tokens, trimmed, values_match
from graticule.operators.reconcile import best_match


@dataclass(frozen=True)
class Mapping:
    """A field to compare; an entry is matched only if all required ones match."""

    name: str
    required: bool = False


@dataclass(frozen=True)
class Field:
    """Where a side holds a field: one column, or several that make up its value."""

    name: str
    columns: tuple[str, ...]
    separator: str = "-"


@dataclass(frozen=True)
class Source:
    """A list table with its fields; ``order`` numbers its rows."""

    name: str
    rows: DataFrame
    fields: tuple[Field, ...]
    order: str


def field_of(fields: Sequence[Field], name: str) -> Field | None:
    """The field of this name, else one whose name differs in case only."""
    return next((f for f in fields if f.name == name), None) or next((f for f in fields if f.name.lower() == name.lower()), None)


def source_columns(fields: Sequence[Field]) -> list[str]:
    """The columns that the fields need, each once, in order."""
    return list(dict.fromkeys(c for f in fields for c in f.columns))


def primary(mappings: Sequence[Mapping]) -> Mapping:
    """The first required mapping, else the first."""
    if not mappings:
        raise ValueError("at least one field mapping is needed")
    return next((m for m in mappings if m.required), mappings[0])


def value(fields: Sequence[Field], name: str) -> Column:
    """A field's composed value; empty where the side has no such field."""
    f = field_of(fields, name)
    return compose([F.col(c).cast("string") for c in f.columns], f.separator) if f else F.lit("")


def _values(fields: Sequence[Field], mappings: Sequence[Mapping]) -> Column:
    return F.struct(*[value(fields, m.name).alias(m.name) for m in mappings])


def united(sources: Sequence[Source], mappings: Sequence[Mapping], settings: Settings, prefix: str | None) -> DataFrame:
    """(_source, _at, _raw, _key, _valid, _t): the rows of all tables with the number of their source and their values."""
    head = primary(mappings).name
    parts = []
    for i, s in enumerate(sources):
        raw = value(s.fields, head)
        valid = code_prefix(raw, prefix) if prefix else trimmed(raw) != ""
        parts.append(s.rows.select(F.lit(s.name).alias("_source"), F.struct(F.lit(i).alias("i"), F.col(s.order).cast("string").alias("o")).alias("_at"), normalized(raw, settings).alias("_key"), valid.alias("_valid"), _values(s.fields, mappings).alias("_t")))
    return reduce(DataFrame.unionByName, parts)


def field_results(mappings: Sequence[Mapping], settings: Settings) -> Column:
    """name -> (table_value, folder_value, matched, similarity) from the structs _t and _f, of which one may be null."""

    def one(name: str) -> Column:
        a, b = F.coalesce(F.col("_t")[name], F.lit("")), F.coalesce(F.col("_f")[name], F.lit(""))
        both = F.col("_t").isNotNull() & F.col("_f").isNotNull()
        alike = F.when(both & (a != "") & (b != ""), jaccard(tokens(a), tokens(b))).otherwise(0.0)
        return F.struct(a.alias("table_value"), b.alias("folder_value"), (both & values_match(a, b, settings)).alias("matched"), alike.alias("similarity"))

    return F.create_map(*[x for m in mappings for x in (F.lit(m.name), one(m.name))])


def compare(sources: Sequence[Source], folder: DataFrame, fields: Sequence[Field], mappings: Sequence[Mapping], key: str = "document_id", settings: Settings = Settings(), prefix: str | None = None) -> DataFrame:
    """(primary_key, status, match_score, source_table, document_id, field_results), a row per table key and per folder key that none chose.

    Of equal table keys the first one counts, in the order of the tables and their rows; of equal folder keys the last one
    by ``key``, in the first one's place. Status: matched if all fields match, partial if a key has a partner but some field
    does not match, missing_from_folder, missing_from_table.
    """
    rows = united(sources, mappings, settings, prefix).filter(F.col("_valid") & (F.col("_key") != ""))
    t = rows.groupBy(F.col("_key").alias("t_key")).agg(F.min_by(F.struct("_source", "_t"), "_at").alias("r")).select("t_key", "r._source", "r._t")
    f = folder.select(F.col(key).alias("_id"), normalized(value(fields, primary(mappings).name), settings).alias("f_key"), _values(fields, mappings).alias("_f")).filter("f_key <> ''")
    f = f.groupBy("f_key").agg(F.max_by(F.struct("_id", "_f"), "_id").alias("r"), F.min("_id").alias("pos")).select("f_key", "pos", "r._id", "r._f")
    best = best_match(t, f, settings.threshold)
    results = field_results(mappings, settings)
    all_match = reduce(lambda x, y: x & y, [F.col("field_results")[m.name]["matched"] for m in mappings])
    hit = F.col("f_key").isNotNull()
    left = t.join(best, "t_key", "left").join(f, "f_key", "left").withColumn("field_results", results)
    status = F.when(~hit, "missing_from_folder").when(all_match, "matched").otherwise("partial")
    a = left.select(F.col("t_key").alias("primary_key"), status.alias("status"), F.col("score").alias("match_score"), F.col("_source").alias("source_table"), F.col("_id").alias("document_id"), "field_results")
    rest = f.join(best, "f_key", "left_anti").withColumn("_t", F.lit(None).cast(t.schema["_t"].dataType)).withColumn("field_results", results)
    b = rest.select(F.col("f_key").alias("primary_key"), F.lit("missing_from_table").alias("status"), F.lit(None).cast("double").alias("match_score"), F.lit(None).cast("string").alias("source_table"), F.col("_id").alias("document_id"), "field_results")
    return a.unionByName(b)


def flat_results(entries: DataFrame) -> DataFrame:
    """A row for each field of each entry."""
    return entries.select("primary_key", "status", "source_table", "document_id", F.round("match_score", 6).alias("match_score"), F.explode("field_results").alias("field_name", "r")).select("*", "r.table_value", "r.folder_value", "r.matched", F.round("r.similarity", 6).alias("similarity")).drop("r")


def diagnostics(sources: Sequence[Source], folder: DataFrame, fields: Sequence[Field], mappings: Sequence[Mapping], settings: Settings = Settings(), prefix: str | None = None) -> DataFrame:
    """(side, total, filtered, empty): rows of each table and of the folder, those without a valid code, and whether there is no value at all.

    A table without rows stands there with zeros.
    """
    rows = united(sources, mappings, settings, prefix)
    names = folder.sparkSession.createDataFrame([(s.name,) for s in sources], "side string")
    blank = lambda c: reduce(lambda x, y: x & y, [trimmed(F.col(c)[m.name]) == "" for m in mappings])
    counts = rows.groupBy(F.col("_source").alias("side")).agg(F.count("*").alias("total"), F.count_if(~F.col("_valid")).alias("filtered"), F.bool_and(blank("_t")).alias("empty"))
    tables = names.join(counts, "side", "left").na.fill(0, ["total", "filtered"]).withColumn("empty", F.coalesce("empty", F.lit(True)))
    own = folder.select(_values(fields, mappings).alias("_f")).agg(F.count("*").alias("total"), F.coalesce(F.bool_and(blank("_f")), F.lit(True)).alias("empty"))
    return tables.unionByName(own.select(F.lit("folder").alias("side"), "total", F.lit(0).cast("bigint").alias("filtered"), "empty"))


def sample_keys(keys: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first keys of a side, for the report of an empty comparison."""
    return keys.select(column).distinct().orderBy(column).limit(n)
