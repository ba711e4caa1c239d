"""Reconciliation of code lists with document metadata: sources, keys, fuzzy best match, statuses and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.functions.text import Settings, code_prefix, jaccard, normalized, tokens, values_match


def pivot_fields(df: DataFrame, fields: list[str], entity: tuple[str, ...] = ("document_id", "document_name"), attribute: str = "field_name", value: str = "value_text") -> DataFrame:
    """Conditional maxima per field, the plain attribute pivot; names differing in case stay apart, as they are literals."""
    if not fields:
        raise ValueError("at least one field is needed")
    own = df.filter(F.col(attribute).isin(fields))
    return own.groupBy(*entity).agg(*[F.max(F.when(F.col(attribute) == f, F.col(value))).alias(f) for f in fields])


def field_list(df: DataFrame, attribute: str = "field_name", limit: int = 100) -> DataFrame:
    return df.select(attribute).filter(F.col(attribute) != "").distinct().orderBy(attribute).limit(limit)


def case_twins(df: DataFrame, attribute: str = "field_name") -> DataFrame:
    """Names that differ from another one only in case."""
    names = df.select(F.col(attribute).alias("field")).filter("field is not null").distinct()
    other = names.select(F.col("field").alias("suggestion"))
    return names.join(other, F.lower("field") == F.lower("suggestion")).filter("field <> suggestion")


def extracted_values(df: DataFrame, columns: dict[str, str], cols: str = "cols") -> DataFrame:
    """Named columns of an extracted table's map; missing ones are empty."""
    return df.select("row_id", "source_name", *[F.coalesce(F.col(cols)[c], F.lit("")).alias(a) for a, c in columns.items()])


def first_by_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Per key the first row in the given order."""
    return df.groupBy(key).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in keep])


def last_by_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Per key the last row, but with the place of the first one as ``pos``."""
    agg = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_f"), F.min(F.struct(*order)).alias("_p"))
    return agg.select(key, F.col("_p").getField(order[0]).alias("pos"), *[F.col("_f")[c].alias(c) for c in keep])


#: Tokens of a key up to which its sets of tokens are listed.
LISTED = 10


def _token_sets(df: DataFrame, toks: str, threshold: float) -> DataFrame:
    """The rows with each set of their tokens that a match at the threshold can share (``sub``, of ``s`` tokens)."""
    n = F.size(toks)
    least = F.ceil(n * F.lit(threshold) - F.lit(1e-9))
    masks = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1), lambda m: F.bit_count(m) >= least)
    rows = df.filter((n > 0) & (n <= LISTED)).withColumn("_m", F.explode(masks))
    sub = F.expr(f"array_join(filter({toks}, (t, i) -> shiftright(_m, i) % 2 = 1), '\\u0001')")
    return rows.withColumns({"sub": sub, "s": F.bit_count("_m").cast("int"), "n": n}).drop("_m")


def best_match(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(t_key, f_key, score): for each left key the right key of the highest token similarity, the earliest of equals.

    left: t_key; right: f_key, pos. A match shares a set of s tokens; of all right keys with m tokens that hold this set
    only the earliest can be the best, so the right keys are first reduced to one per (set, m). The left keys meet these
    through their own sets: the score s / (n + m - s) of the whole intersection is the greatest. No set emits pairs, and
    a token that stands in all keys costs a row per key. Keys of more than ``LISTED`` tokens meet on their rarest tokens.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0; at 0 every key matches the first one")
    a = left.select("t_key", F.array_sort(tokens(F.col("t_key"))).alias("ta"))
    b = right.select("f_key", "pos", F.array_sort(tokens(F.col("f_key"))).alias("tb"))
    first = _token_sets(b, "tb", threshold).groupBy("sub", F.col("n").alias("m")).agg(F.min(F.struct("pos", "f_key")).alias("r"))
    met = _token_sets(a, "ta", threshold).select("t_key", "sub", "s", "n").join(first, "sub")
    score = F.col("s").cast("double") / (F.col("n") + F.col("m") - F.col("s"))
    listed = met.select("t_key", "r.f_key", "r.pos", score.alias("score")).filter(F.col("score") >= threshold)
    # keys without a token are alike
    empty = a.filter(F.size("ta") == 0).select("t_key", F.lit(1).alias("_e")).join(b.filter(F.size("tb") == 0).agg(F.min(F.struct("pos", "f_key")).alias("m")).filter("m is not null").select(F.lit(1).alias("_e"), "m"), "_e").select("t_key", F.col("m.f_key").alias("f_key"), F.col("m.pos").alias("pos"), F.lit(1.0).alias("score"))
    scored = listed.unionByName(_long_keys(a, b, threshold)).unionByName(empty)
    return scored.groupBy("t_key").agg(F.min(F.struct(-F.col("score"), "pos", "f_key")).alias("_b")).select("t_key", F.col("_b.f_key").alias("f_key"), (-F.col("_b.col1")).alias("score"))


def _long_keys(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Scored pairs of which a side has more than ``LISTED`` tokens.

    Of a key with n tokens, a partner at the threshold shares one of the n - ceil(threshold * n) + 1 rarest; a partner's
    number of tokens lies between threshold * n and n / threshold.
    """
    least = LISTED * threshold  # shorter keys have no partner that long
    a, b = a.filter(F.size("ta") > least), b.filter(F.size("tb") > least)
    words = a.select(F.explode("ta").alias("w")).unionAll(b.select(F.explode("tb").alias("w"))).groupBy("w").count()

    def prefix(df: DataFrame, key: str, toks: str) -> DataFrame:
        ranked = df.select(key, F.size(toks).alias("n"), F.explode(toks).alias("w")).join(words, "w").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("count", "w"))).alias("r"))
        take = F.size("r") - F.ceil(F.size("r") * F.lit(threshold) - F.lit(1e-9)) + 1
        return ranked.select(key, F.col("n").alias(f"n_{key}"), F.explode(F.slice("r", F.lit(1), take.cast("int"))).alias("x")).select(key, f"n_{key}", F.col("x.w").alias("w"))

    met = prefix(a, "t_key", "ta").join(prefix(b, "f_key", "tb"), "w").filter((F.greatest("n_t_key", "n_f_key") > LISTED) & (F.least("n_t_key", "n_f_key") >= threshold * F.greatest("n_t_key", "n_f_key")))
    pairs = met.select("t_key", "f_key").distinct()
    return pairs.join(a, "t_key").join(b, "f_key").withColumn("score", jaccard(F.col("ta"), F.col("tb"))).filter(F.col("score") >= threshold).select("t_key", "f_key", "pos", "score")


def reconcile(table: DataFrame, folder: DataFrame, settings: Settings = Settings(), prefix: str | None = None) -> DataFrame:
    """One row per table key and per folder key that none chose.

    table: code, description, source, ord (unique); folder: code, description, document_id (unique order key).
    Status: matched (code and description agree: equal, contained or blank), partial, missing_from_folder, missing_from_table.
    """
    t = table.withColumn("t_key", normalized(F.col("code"), settings)).filter("t_key <> ''")
    t = t.filter(code_prefix(F.col("code"), prefix)) if prefix else t
    t = first_by_key(t, "t_key", ["ord"], ["ord", "code", "description", "source"])
    f = folder.withColumn("f_key", normalized(F.col("code"), settings)).filter("f_key <> ''")
    f = last_by_key(f, "f_key", ["document_id"], ["document_id", "code", "description"]).withColumnsRenamed({"code": "f_code", "description": "f_description"})
    best = best_match(t, f, settings.threshold)
    left = t.join(best, "t_key", "left").join(f, "f_key", "left")
    hit = F.col("f_key").isNotNull()
    code_ok, text_ok = values_match(F.col("code"), F.col("f_code"), settings), values_match(F.col("description"), F.col("f_description"), settings)
    status = F.when(~hit, "missing_from_folder").when(code_ok & text_ok, "matched").otherwise("partial")
    both = hit & (F.coalesce("description", F.lit("")) != "") & (F.coalesce("f_description", F.lit("")) != "")
    alike = jaccard(tokens(F.col("description")), tokens(F.col("f_description")))
    similarity = F.when(both, F.round(alike, 6))
    a = left.select(F.col("t_key").alias("primary_key"), status.alias("status"), F.round("score", 6).alias("score"), "source", "document_id", similarity.alias("description_score"), F.when(both, alike >= settings.threshold).alias("description_match"))
    b = f.join(best, "f_key", "left_anti").select(F.col("f_key").alias("primary_key"), F.lit("missing_from_table").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("source"), "document_id", F.lit(None).cast("double").alias("description_score"), F.lit(None).cast("boolean").alias("description_match"))
    return a.unionByName(b)


def summary(entries: DataFrame) -> DataFrame:
    """Counts by status and by score class."""
    n = lambda c: F.count_if(c)
    s, d = F.col("score"), F.col("description_score")
    return entries.agg(
        *[n(F.col("status") == x).alias(x) for x in ("matched", "partial", "missing_from_folder", "missing_from_table")],
        n(s == 1).alias("score_exact"), n((s >= 0.9) & (s < 1)).alias("score_high"), n((s >= 0.7) & (s < 0.9)).alias("score_medium"), n(s < 0.7).alias("score_low"),
        n(d == 1).alias("desc_exact"), n((d >= 0.9) & (d < 1)).alias("desc_high"), n((d >= 0.5) & (d < 0.9)).alias("desc_medium"), n(d < 0.5).alias("desc_low"), n(~F.col("description_match")).alias("desc_mismatch"),
    )


def source_stats(table: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source: its rows, and how its keys came out; sources without any key stand there too."""
    rows = table.groupBy("source").agg(F.count("*").alias("entries"))
    out = entries.filter("source is not null").groupBy("source").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("matched", "partial", "missing_from_folder")])
    return rows.join(out, "source", "left").na.fill(0, ["matched", "partial", "missing_from_folder"])
