"""Stored results: paths into semi-structured values, typed filters, paging, summaries, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = {"$gte": lambda a, b: a >= b, "$lte": lambda a, b: a <= b, "$gt": lambda a, b: a > b, "$lt": lambda a, b: a < b}


def navigate(value: Column, path: str) -> Column:
    """The part at a path such as a.b[2].c of a JSON text; null where there is none."""
    return F.get_json_object(value, "$." + path if path and not path.startswith("[") else "$" + path)


def equals(value: Column, path: str, literal) -> Column:
    """Strict equality: the type must be equal as well as the value; objects and lists never are."""
    v = F.try_parse_json(value)
    at = "$." + path
    kind = F.schema_of_variant(F.variant_get(v, at, "variant"))
    if literal is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(literal, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(v, at, "boolean") == literal), F.lit(False))
    if isinstance(literal, (int, float)):
        return F.coalesce((kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")) & (F.try_variant_get(v, at, "double") == float(literal)), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(v, at, "string") == literal), F.lit(False))


def in_range(c: Column, limits: dict[str, str]) -> Column:
    """Times within limits; what is no time is out of range."""
    out = F.lit(True)
    for op, limit in limits.items():
        out = out & RANGES[op](c, F.lit(limit).cast("timestamp"))
    return F.coalesce(out, F.lit(False))


def moment(value: Column, path: str) -> Column:
    """A time within a JSON value: a text that reads as one, or milliseconds since 1970."""
    at = F.variant_get(F.try_parse_json(value), "$." + path, "variant")
    number = F.schema_of_variant(at).isin("BIGINT", "DOUBLE") | F.schema_of_variant(at).startswith("DECIMAL")
    text = F.get_json_object(value, "$." + path)
    return F.when(number, F.timestamp_millis(text.try_cast("double").cast("bigint"))).otherwise(text.try_cast("timestamp"))


def matches(value: Column, document: dict[str, object]) -> Column:
    """Whether all parts of a filter document hold: equal values of equal type, or limits of a time, under dotted keys."""
    out = F.lit(True)
    for path, wanted in document.items():
        out = out & (in_range(moment(value, path), wanted) if isinstance(wanted, dict) else equals(value, path, wanted))
    return F.coalesce(out, F.lit(False))


def query_items(df: DataFrame, item: str, document: dict[str, object], order: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
    """The slice of the matching rows under a total order, with their total and whether more follow."""
    found = df.filter(matches(F.col(item), document))
    total = found.agg(F.count("*").alias("total"))
    # the total is one row
    return page(found, order, offset, limit).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + (limit or 20))


def paging(number: int = 1, size: int = 20, most: int = 100) -> tuple[int, int]:
    """(skip, take) of a page from 1 on; a page shows at most ``most`` rows, while skipping goes by the size asked for."""
    return (number - 1) * size, min(size, most)


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
    """A slice under a total order; a limit of 0 is the default."""
    return df.orderBy(*order).offset(offset).limit(limit or 20)


def envelope(df: DataFrame, skip: int, take: int) -> DataFrame:
    """Page number, rows on the page, whether more follow, and the true total."""
    total = F.count("*")
    count = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(take).cast("bigint"), total - skip))
    return df.agg(F.lit(skip // take + 1).alias("page"), count.alias("page_count"), (total > skip + take).alias("has_more"), total.alias("total_count"))


def summaries(df: DataFrame, key: str, text: str) -> DataFrame:
    """Kind of each stored value; of lists the number of items, the first three and the first one's keys, of objects their keys and the length of ``data``.

    Keys stand as written: the first ten of an item, the first twenty of an object.
    """
    v = F.regexp_replace(text, "^\ufeff", "")
    kind = F.when(F.try_parse_json(v).isNull(), "unreadable").when(F.ltrim(v).startswith("["), "array").when(F.ltrim(v).startswith("{"), "object").otherwise("scalar")
    list_, object_ = kind == "array", kind == "object"
    first = F.get_json_object(v, "$[0]")
    items = F.slice(F.from_json(v, "array<string>"), 1, 3)
    data = F.get_json_object(v, "$.data")
    cols = {
        "kind": kind, "items": F.when(list_, F.json_array_length(v)), "first_items": F.when(list_, F.array_join(items, "\n", "null")),
        "item_keys": F.when(list_ & first.startswith("{"), F.array_join(F.slice(F.json_object_keys(first), 1, 10), ",")),
        "keys": F.when(object_, F.array_join(F.slice(F.json_object_keys(v), 1, 20), ",")),
        "data_length": F.when(object_ & F.ltrim(data).startswith("["), F.json_array_length(data)),
    }
    return df.select(key, *[c.alias(n) for n, c in cols.items()])


def spill(df: DataFrame, key: str, text: str, limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(kept, spilled): results up to the limit as they are, longer ones as a stub with their size."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    kept = df.filter(size <= limit)
    return kept, df.filter(size > limit).select(key, size.alias("size_chars"), F.substring(text, 1, 200).alias("head"))


def expire(df: DataFrame, at: str, now_ms: int, keep_ms: int = 3_600_000) -> DataFrame:
    """Entries not older than the retention."""
    return df.filter(F.col(at) >= now_ms - keep_ms)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line, ord) of an export: the header with ord 0, then a line for each row; nested cells are JSON texts."""
    from graticule.functions.text import csv_cell

    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "struct", "map"))
    cell = lambda c: F.coalesce(F.to_json(c), F.lit('""')) if nested(c) else csv_cell(F.col(c), kinds[c])
    head = df.sparkSession.range(1).select(F.lit(",".join(df.columns)).alias("line"), F.lit(0).alias("ord"))
    return head.unionByName(df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"), F.lit(1).alias("ord")))


def export_csv(df: DataFrame, path: str) -> None:
    """Part files of lines, and the header in a folder of its own."""
    lines = csv_lines(df)
    lines.filter("ord = 1").select("line").write.mode("overwrite").option("header", "false").text(path)
    lines.filter("ord = 0").select("line").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_header")


def export_json(df: DataFrame, path: str) -> None:
    """An object per line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """File names made unique: the first keeps its name, later ones get (n) before the ending.

    Numbering is in order within a name: a sort per name, which spills, not a collected group.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("("), n.cast("string"), F.lit(")"), end)))
