"""Clause pipeline: valid elements, context of a clause, positional results with defaults, decisions."""

from __future__ import annotations

import base64
import binascii
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graticule.functions.text import trimmed

MISSING = "contesto non trovato"


def exploded(df: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, pos, item) of the elements that aren't blank."""
    return df.select(key, F.posexplode(items).alias("pos", "item")).filter(trimmed(F.coalesce("item", F.lit(""))) != "")


def context(clauses: DataFrame, sections: DataFrame, key: str, text: bool = False) -> DataFrame:
    """Each clause with the first section of its document that contains it; sections: key, ord, section.

    With ``text`` the section itself stands in the result, or a sentinel where there is none.
    """
    c = clauses.withColumn("_t", trimmed(F.col("clause")))
    hit = c.join(sections, key).filter(F.contains(trimmed(F.col("section")), F.col("_t")) & (F.col("_t") != ""))
    first = hit.groupBy(key, "pos").agg(F.min_by("ord", "ord").alias("section_ord"))
    out = clauses.join(first, [key, "pos"], "left").withColumn("found", F.col("section_ord").isNotNull())
    return out if not text else out.join(sections.withColumnRenamed("ord", "section_ord"), [key, "section_ord"], "left").withColumn("section", F.coalesce("section", F.lit(MISSING)))


def zipped(originals: DataFrame, results: DataFrame, keys: list[str], column: str, default: str) -> DataFrame:
    """Results beside their originals by position; a missing or blank one is the default."""
    r = results.select(*keys, F.col(column).alias("_r"))
    return originals.join(r, keys, "left").withColumn(column, F.when(trimmed(F.col("_r")) != "", F.col("_r")).otherwise(F.lit(default))).drop("_r")


def decision(status: Column, keep: Column, text: Column) -> Column:
    """errore, scarta, popola or modifica, from the three steps' results."""
    return F.when(status.isNull(), "errore").when(~F.coalesce(keep, F.lit(False)), "scarta").when(trimmed(F.coalesce(text, F.lit(""))) == "", "popola").otherwise("modifica")


def header_map(c: Column) -> Column:
    """Header fields by lower-cased name; of duplicates the last counts."""
    names = F.array_distinct(F.transform(c, lambda h: F.lower(h["name"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(c, lambda h: F.lower(h["name"]) == n), -1)["value"]))


def plain_body(c: Column) -> Column:
    """Mail text without markup."""
    return F.regexp_replace(c, "<[^>]+>", "")


def decoded(c: Column) -> Column:
    """Text of a URL-safe base64 part."""
    return F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")


def clause_counts(df: DataFrame, items: Column) -> DataFrame:
    """Rows, clauses and valid clauses."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.greatest(F.size(items), F.lit(0))), F.lit(0)).alias("clauses"), F.coalesce(F.sum(F.greatest(F.size(F.filter(items, lambda c: trimmed(F.coalesce(c, F.lit(""))) != "")), F.lit(0))), F.lit(0)).alias("valid"))


def zipped_all(originals: DataFrame, others: list[tuple[DataFrame, str, str]], keys: list[str]) -> DataFrame:
    """Several results beside their originals by position: (frame, column, default) each."""
    for frame, column, default in others:
        originals = zipped(originals, frame, keys, column, default)
    return originals


def mail_details(df: DataFrame) -> DataFrame:
    """Messages (headers: array of name and value, labels, snippet) with header fields and the defaults of missing ones.

    Of repeated headers the last counts; starred and label come from the labels.
    """
    h = df.withColumn("_h", header_map(F.col("headers")))
    field = lambda n, d: F.coalesce(F.col("_h")[n], F.lit(d))
    out = h.select("*", field("subject", "No Subject").alias("subject"), field("from", "No Sender").alias("sender"), field("to", "No Recipient").alias("recipient"), field("date", "No Date").alias("date"), F.array_contains("labels", "STARRED").alias("starred"), F.array_join("labels", ",").alias("label"))
    return out.withColumn("snippet", F.coalesce("snippet", F.lit("No Snippet"))).drop("_h", "headers", "labels")


NO_BODY, BAD_BODY = "<Text body not available>", "<Error Fetching Body>"


def _body(payload: str | None) -> str:
    """The first plain part in depth-first order, else the data of a message without parts."""
    if payload is None:
        return NO_BODY
    try:
        top = json.loads(payload)
        if "parts" not in top:
            return _text(top["body"]["data"]) if "data" in top.get("body", {}) else NO_BODY
        todo = list(reversed(top["parts"]))
        while todo:
            part = todo.pop()
            if part.get("mimeType") == "text/plain" and "data" in part.get("body", {}):
                return _text(part["body"]["data"])
            todo += reversed(part.get("parts", []))
        return NO_BODY
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError, binascii.Error):
        return BAD_BODY


def _text(data: str) -> str:
    return base64.urlsafe_b64decode(data).decode("utf-8")


@F.pandas_udf(StringType())
def mime_body(payload: pd.Series) -> pd.Series:
    """Text of a message from its JSON payload of parts within parts."""
    return payload.map(_body)
