"""Parametrised scans and searches over tables, with their order and limits stated."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(name, column, type, ordinal) of tables."""
    rows = [(n, f.name, f.dataType.simpleString(), i) for n in names for i, f in enumerate(spark.read.parquet(f"{sf_dir}/{n}.parquet").schema.fields)]
    return spark.createDataFrame(rows, "name string, column string, type string, ordinal int")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per subfolder; malformed ones are errors."""
    return spark.read.json(f"{folder}/*/manifest.json", multiLine=True, mode="FAILFAST").withColumn("source_file", F.col("_metadata.file_path"))


def api_catalog(df: DataFrame, spec: str = "spec") -> DataFrame:
    """(name, description, path) of the GET operations of an OpenAPI document."""
    paths = F.from_json(F.get_json_object(spec, "$.paths"), "map<string, struct<get: struct<operationId: string, description: string, summary: string>>>")
    rows = df.select(F.explode(paths).alias("path", "item")).filter("item.get is not null")
    return rows.select(F.coalesce("item.get.operationId", F.regexp_replace("path", "[^a-zA-Z0-9]", "_")).alias("name"), F.coalesce("item.get.description", "item.get.summary", F.concat(F.lit("GET "), "path")).alias("description"), "path")


def lookback(df: DataFrame, column: str, as_of: str, days: int = 30) -> DataFrame:
    return df.filter(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def tagged_search(parts: list[tuple[str, DataFrame, str, str]], text: str, limit: int = 10) -> DataFrame:
    """(type, id, label) of the first rows of each entity whose label contains the text."""
    low = text.lower()
    found = [df.filter(F.contains(F.lower(label), F.lit(low))).select(F.lit(kind).alias("type"), F.col(key).cast("bigint").alias("id"), F.col(label).alias("label")).orderBy("id").limit(limit) for kind, df, key, label in parts]
    return reduce(DataFrame.unionByName, found)


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int = 5) -> DataFrame:
    """(key, score) of the k rows of the highest cosine similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    size = sum(x * x for x in query) ** 0.5
    return df.select(key, F.round(dot / (norm * size), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def after(df: DataFrame, order: str, last, size: int) -> DataFrame:
    """The page that follows a key."""
    return (df if last is None else df.filter(F.col(order) > F.lit(last))).orderBy(order).limit(size)


def mailbox(df: DataFrame, label: str = "ALL", text: str | None = None) -> DataFrame:
    """Messages with a label (ALL: any) whose subject or body contains the text."""
    out = df if label == "ALL" else df.filter(F.array_contains(F.split(F.coalesce("label", F.lit("")), ","), label))
    if text:
        low = F.lit(text.lower())
        out = out.filter(F.coalesce(F.contains(F.lower("subject"), low), F.lit(False)) | F.coalesce(F.contains(F.lower("body"), low), F.lit(False)))
    return out


def sent_files(df: DataFrame, extensions: tuple[str, ...], column: str) -> DataFrame:
    """Rows whose file name has one of the endings."""
    return df.filter(F.lower(F.regexp_extract(column, r"\.([^.]+)$", 1)).isin(*extensions))


@dataclass(frozen=True)
class Scan:
    """A search with declared parameters: a text contained in a column, equal values, an order and pages.

    Parameters without a value don't filter; others than the declared ones are errors. A page has at most 100 rows.
    """

    text: str | None = None
    equal: dict[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    def run(self, df: DataFrame, params: dict[str, object]) -> DataFrame:
        given = {k: v for k, v in params.items() if v is not None}
        if unknown := set(given) - {"search_text", "page", "page_size", *self.equal}:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if self.text and "search_text" in given:
            df = df.filter(F.contains(F.lower(self.text), F.lit(str(given["search_text"]).lower())))
        for name, column in self.equal.items():
            if name in given:
                df = df.filter(F.col(column) == F.lit(given[name]))
        number, size = int(given.get("page", 1)), int(given.get("page_size", 20))
        return df.orderBy(*self.order).offset((number - 1) * size).limit(min(size, 100))


def path_of(template: str, params: dict[str, object]) -> str:
    """A path with its {name} parts replaced by encoded values."""
    from urllib.parse import quote

    for name, value in params.items():
        template = template.replace("{" + name + "}", quote(str(value), safe=""))
    return template


def balances(df: DataFrame, account: str, amount: str, limit: int = 100) -> DataFrame:
    """(account, balance) of the first accounts of the report."""
    return df.groupBy(account).agg(F.sum(amount).alias("balance")).orderBy(account).limit(limit)


def png_size(df: DataFrame, content: str = "content") -> DataFrame:
    """Width and height from the header of PNG files; null where the bytes are no PNG."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("bigint")
    ok = head.startswith("89504E470D0A1A0A") & (F.length(head) == 48)
    return df.select("*", F.when(ok, number(33)).alias("width"), F.when(ok, number(41)).alias("height"))


def page_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, text) of texts whose pages end at form feeds; blank pages are left out."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1).filter(F.trim("text") != "")


def category_file(spark: SparkSession, path: str) -> DataFrame:
    """(category, name) of a JSON file of categories; a missing or unreadable file gives none."""
    empty = spark.createDataFrame([], "category string, name string")
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("category", "names")).select("category", F.explode("names").alias("name"))
    except Exception:  # noqa: BLE001 - fail-soft by definition
        return empty
