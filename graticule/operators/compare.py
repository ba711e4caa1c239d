"""Differences between two copies of data (problem 7).

A checksum matrix of key buckets by columns is built on each side: additive hashes, 2 x 64 bits wide, summed per bucket
and column. Buckets whose sums are equal hold equal data. Only the rows of unequal buckets are read again, with the values
of the columns that are unequal in their bucket (the others are null from the scan on), joined and compared.

The first reading shuffles no values: the latest version of a key is the greatest (time, hashes of its columns), a
combinable aggregate over hashes, so a key with a third of all rows is reduced before the shuffle. The matrix has a row per
bucket, never per key, and is joined, not collected; what is collected is the list of columns that are unequal anywhere.

Defined cases: a null key is a key; of versions with the same time the one with the greatest hashes counts, on both sides
alike; a null time is the earliest; empty tables make all keys of the other side missing; columns other than those named
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.session import checkpointed

TOLERANCE = 1e-9
#: Unequal buckets, about 100 bytes each, up to which their list is broadcast.
LIST = 200_000
MEMBERS = ("table_value", "folder_value", "matched", "similarity")


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key, F.lit("\u0000"))), F.lit(buckets)).cast("int")


def _entries(col: Column) -> Column:
    """A map in the order of its names; null where it is empty."""
    sorted_ = F.array_sort(F.map_entries(col))
    return F.when(F.size(sorted_) > 0, sorted_)


def _form(c: str, kind: str, maps: list[str]) -> Column:
    """A column as it is compared: maps as their sorted entries."""
    return _entries(F.col(c)) if c in maps else F.col(c)


def _hash(value: Column, kind: str, seed: int) -> Column:
    """A hash that sees nulls: xxhash64 passes over those within a value, JSON with its null fields shows where they stand."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}) if kind.startswith(("array", "struct", "map")) else value
    return F.xxhash64(F.lit(seed), value.isNull(), text)


def hashed(df: DataFrame, key: str, columns: list[str], maps: list[str], at: str, buckets: int) -> DataFrame:
    """(_bucket, _a, _b, _at, _h): of every row its key's bucket and hash of 128 bits, its time and its columns' hashes."""
    kinds = dict(df.dtypes)
    k = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    h = F.struct(*[_hash(_form(c, kinds[c], maps), kinds[c], 11).alias(c) for c in [*columns, *maps]])
    return df.select(bucket(F.col(key), buckets).alias("_bucket"), F.xxhash64(k).alias("_a"), F.xxhash64(F.lit(5), k).alias("_b"), F.col(at).alias("_at"), h.alias("_h"))


def checksum_matrix(df: DataFrame, key: str, columns: list[str], maps: list[str], at: str, buckets: int) -> DataFrame:
    """(_bucket, _n, _key and one text of two sums per column) of the latest versions."""
    best = hashed(df, key, columns, maps, at, buckets).groupBy("_bucket", "_a", "_b").agg(F.max(F.struct("_at", "_h")).alias("_v"))
    wide = lambda *parts: F.concat_ws("|", *[F.sum(F.xxhash64(F.lit(seed), "_a", "_b", *parts).cast("decimal(20,0)")).cast("string") for seed in (11, 12)])
    return best.groupBy("_bucket").agg(F.count("*").alias("_n"), wide().alias("_key"), *[wide(F.col("_v")["_h"][c]).alias(c) for c in [*columns, *maps]])


def unequal(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(_bucket, _columns): the buckets of two matrices that differ, and the columns in which they do."""
    both = left.alias("a").join(right.alias("b"), F.col("a._bucket") == F.col("b._bucket"), "full")
    different = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ["_key", *columns]]))
    return both.select(F.coalesce("a._bucket", "b._bucket").alias("_bucket"), different.alias("_columns")).filter(F.size("_columns") > 0)


def _differ(a: Column, b: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        near = (F.abs(a - b) < TOLERANCE) | (F.isnan(a) & F.isnan(b)) | (a == b)
        return ~F.coalesce(near, a.isNull() & b.isNull())
    return ~a.eqNullSafe(b)


def compare(left: DataFrame, right: DataFrame, key: str = "primary_key", columns: tuple[str, ...] = ("status", "match_score", "source_table", "document_id", "document_name"), maps: tuple[str, ...] = ("field_results",), at: str = "updated_at", names: tuple[str, str] = ("entries", "copy"), buckets: int | None = None) -> DataFrame:
    """(key, diff_kind, field_name): keys that one side lacks, and the differing fields of the others.

    ``buckets`` is by default sized to the input's files: about one bucket per 4 KB, from 1,024 to 4 million. More buckets
    than differing keys keep the second reading small; any number gives the same result.
    """
    columns, maps = list(columns), list(maps)
    if buckets is None:
        size = int(str(left._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = max(1 << 10, min(1 << 22, size // 4096))
    kinds = dict(left.dtypes)
    everything = [*columns, *maps]
    found = checkpointed(unequal(*(checksum_matrix(x, key, columns, maps, at, buckets) for x in (left, right)), everything))  # read for the columns and by both sides
    open_ = {r[0] for r in found.select(F.explode("_columns")).distinct().collect()}
    # a short list of buckets goes to the rows, else the rows go to their buckets; the result is the same
    found = F.broadcast(found) if found.count() <= LIST else found

    def again(df: DataFrame) -> DataFrame:
        # rows of unequal buckets with their unequal values; versions are picked by the hashes of all columns, as before
        h = F.struct(*[_hash(_form(c, kinds[c], maps), kinds[c], 11).alias(c) for c in everything])
        marked = df.select(F.col(key).alias("_key"), F.col(at).alias("_at"), h.alias("_h"), *[_form(c, kinds[c], maps).alias(c) for c in everything], bucket(F.col(key), buckets).alias("_bucket")).join(found, "_bucket")
        value = lambda c: F.when(F.array_contains("_columns", c), F.col(c)) if c in open_ else F.lit(None).cast(marked.schema[c].dataType)
        best = marked.groupBy("_key").agg(F.max_by(F.struct(*[value(c).alias(c) for c in everything]), F.struct("_at", "_h")).alias("_row"))
        return best.select("_key", *[F.col("_row")[c].alias(c) for c in everything])

    a, b = again(left).withColumn("_here", F.lit(True)).alias("a"), again(right).withColumn("_here", F.lit(True)).alias("b")
    pairs = a.join(b, F.col("a._key").eqNullSafe(F.col("b._key")), "full")
    flat = [F.when(_differ(F.col(f"a.{c}"), F.col(f"b.{c}"), kinds[c]), F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in columns]
    nested = [_map_fields(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in maps]
    one_side = F.when(F.col("b._here").isNull(), F.lit(f"missing_in_{names[1]}")).when(F.col("a._here").isNull(), F.lit(f"missing_in_{names[0]}"))
    fields = F.when(one_side.isNotNull(), F.array(F.lit(""))).otherwise(F.concat(*flat, *nested))
    out = pairs.select(F.when(F.col("a._here"), F.col("a._key")).otherwise(F.col("b._key")).alias(key), F.coalesce(one_side, F.lit("differs")).alias("diff_kind"), F.explode(fields).alias("field_name"))
    return out


def _map_fields(a: Column, b: Column) -> Column:
    """Names that only one side's sorted entries have, and NAME.MEMBER where both have the name and the member differs."""
    a = F.coalesce(a, F.filter(b, lambda e: F.lit(False)), F.lit(None))
    b = F.coalesce(b, F.filter(a, lambda e: F.lit(False)), F.lit(None))
    names = lambda e: F.transform(e, lambda x: x["key"])
    lone = F.concat(F.array_except(names(a), names(b)), F.array_except(names(b), names(a)))

    def members(x: Column) -> Column:
        y = F.element_at(F.filter(b, lambda e: e["key"] == x["key"]), 1)
        kind = {"matched": "boolean", "similarity": "double"}
        parts = [F.when(_differ(x["value"][m], y["value"][m], kind.get(m, "string")), F.concat(x["key"], F.lit(f".{m}"))) for m in MEMBERS]
        return F.array_compact(F.array(*parts))

    common = F.filter(a, lambda e: F.array_contains(names(b), e["key"]))
    return F.coalesce(F.concat(lone, F.flatten(F.transform(common, members))), F.array().cast("array<string>"))
