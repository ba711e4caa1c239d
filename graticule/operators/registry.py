"""Catalogue of tools: visibility, search, merging with manifests, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("enabled") & F.col("visibility").isin("public", "beta"))


def search_regex(df: DataFrame, pattern: str, columns: list[str], tags: str | None = None, literal: bool = False) -> DataFrame:
    """Rows in which the pattern, whatever the case, occurs in a column or in a tag."""
    p = "(?i)" + (r"\Q" + pattern + r"\E" if literal else pattern)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(p), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.coalesce(t.rlike(p), F.lit(False))), F.lit(False))
    return df.filter(hit)


def search_substring(df: DataFrame, text: str, columns: list[str], tags: str | None = None, category: str = "all") -> DataFrame:
    low = text.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.coalesce(F.contains(F.lower(t), F.lit(low)), F.lit(False))), F.lit(False))
    return df.filter(hit if category == "all" else hit & (F.col("category") == category))


def current(df: DataFrame, key: str = "mcp_id", at: str = "updated_at") -> DataFrame:
    """The latest row of each id; equal times give the greatest row by its text."""
    return df.withColumn("_o", F.struct(F.col(at), F.to_json(F.struct(*[c for c in df.columns if c != at])))).groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "_o").alias("_r")).select(key, "_r.*")


def docker_defaults(stored: Column, transport: Column, port: Column | None = None, manifest: Column | None = None, manifest_transport: Column | None = None) -> Column:
    """Nested defaults: the manifest's part, else the stored one, else the row's own column or the fixed value.

    ``resources`` is taken whole from the first side that has it; mounts are null where neither side has any.
    """
    first = lambda name, *more: F.coalesce(*([manifest[name]] if manifest is not None else []), stored[name], *more).alias(name)
    own_port = port if port is not None else F.lit(None).cast("int")
    by = F.coalesce(*([manifest_transport] if manifest_transport is not None else []), transport, F.lit(""))
    return F.struct(
        first("container_port", own_port), first("sse_endpoint"), first("protocol", F.lit("tcp")), first("needs_port_mapping", by == "sse"),
        first("default_host_port", own_port), first("needs_file_access", F.lit(False)), first("volume_mounts"),
        first("resources", F.struct(F.lit("512m").alias("memory"), F.lit("0.5").alias("cpus"))),
    )


def merge_manifests(df: DataFrame, manifests: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """Each document with its manifest: the manifest's value, else the document's, else the default."""
    m = manifests.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    out = df.join(m, key, "left")
    return out.select(key, *[F.coalesce(F.col(f"_m_{c}"), F.col(c), F.lit(d)).alias(c) for c, d in columns.items()])


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target with the rows whose key it lacks."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti").select(*target.columns))


def conflicts(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.join(target.select(key), key, "left_semi")


def update(target: DataFrame, changes: DataFrame, key: str, columns: list[str], unset: list[str] = ()) -> DataFrame:
    """Columns set where a change is given; those of ``unset`` become null where the change has none.

    Repeated changes of a key count once, the greatest by the order of the columns.
    """
    names = list(dict.fromkeys([*columns, *unset]))
    changes = changes.groupBy(key).agg(F.max(F.struct(*names)).alias("_c")).select(key, "_c.*")
    c = changes.select(key, F.lit(True).alias("_hit"), *[F.col(x).alias(f"_n_{x}") for x in [*columns, *unset]])
    out = target.join(c, key, "left")
    new = {x: F.coalesce(F.col(f"_n_{x}"), F.col(x)) for x in columns} | {x: F.when(F.col("_hit"), F.col(f"_n_{x}")).otherwise(F.col(x)) for x in unset}
    return out.select(*[new.get(x, F.col(x)).alias(x) for x in target.columns])


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def replace_table(df: DataFrame, path: str, new: str) -> None:
    """Rewrite of a table that is being read: written aside, then taken over by the caller's swap of the paths."""
    if path == new:
        raise ValueError("a table that is read can't be overwritten; give another path")
    df.write.mode("errorifexists").parquet(new)


def lookup(df: DataFrame, id_: object, key: str = "mcp_id") -> DataFrame:
    """The entry of this id, if it is visible; repeated rows of it stay."""
    return visible(df).filter(F.col(key) == F.lit(id_))


def listed(df: DataFrame, category: str | None = None, featured: str | None = None, search: str | None = None) -> DataFrame:
    """Visible entries, of a category if one is given, featured ones if ``featured`` is 'true', that match a pattern if one is given."""
    out = visible(df)
    out = out.filter(F.col("category") == category) if category else out
    out = out.filter(F.col("featured")) if featured == "true" else out
    return search_regex(out, search, ["mcp_name", "description"], "tags") if search else out


def projected(df: DataFrame) -> DataFrame:
    """The public form of entries: every public column, with the defaults of tag, transport and entrypoint; tags without blanks."""
    defaults = {"docker_tag": "latest", "transport": "stdio", "entrypoint": "node /app/dist/index.js"}
    public = ["mcp_id", "mcp_name", "description", "author", "mcp_version", "docker_image", "docker_tag", "entrypoint", "config_schema", "requirements", "icon", "category", "tags", "documentation_url", "features", "docker_defaults", "transport", "port", "sse_endpoint", "needs_file_access", "volume_mounts", "use_local", "local_path", "command", "args"]
    have = set(df.columns)
    value = lambda c: F.coalesce(*([F.col(c)] if c in have else []), F.lit(defaults[c])) if c in defaults else F.col(c)
    out = df.select(*[value(c).alias(c) for c in public if c in have or c in defaults])
    return out.withColumn("tags", F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False)))) if "tags" in have else out


def merge_json(df: DataFrame, manifests: DataFrame, key: str, fall_back: tuple[str, ...] | None = None) -> DataFrame:
    """(key, merged, given): documents with their manifests, both JSON objects whose keys vary (columns doc and manifest).

    Every key that the manifest has wins, also one that the document lacks; a null in it gives way to the document, if
    ``fall_back`` is None or names the key. ``given`` lists the manifest's keys.
    """
    m = F.coalesce(F.from_json("manifest", "map<string,string>"), F.create_map().cast("map<string,string>"))
    d = F.coalesce(F.from_json("doc", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = df.join(manifests.select(key, "manifest"), key, "left").withColumns({"_m": m, "_d": d})
    yields = lambda k: F.lit(True) if fall_back is None else k.isin(*fall_back)
    won = F.map_filter("_m", lambda k, v: v.isNotNull() | ~yields(k) | ~F.map_contains_key("_d", k))
    kept = F.map_filter("_d", lambda k, v: ~F.map_contains_key("_w", k))
    return rows.withColumn("_w", won).select(key, F.map_concat(kept, "_w").alias("merged"), F.map_keys("_m").alias("given"))


def insert_once(target: DataFrame, rows: DataFrame, key: str, order: str, stamps: dict[str, Column]) -> DataFrame:
    """The target with the rows whose key it lacks, the first by ``order`` of each key, with the stamps."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])
    new = first.join(target.select(key), key, "left_anti").withColumns(stamps)
    return target.unionByName(new.select(*target.columns))
