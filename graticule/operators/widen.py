"""Attribute-value rows into wide tables (problem 6).

The entity-by-attribute grid is completed, the values are joined to it, each entity's cells are collected into one array
in the order of the catalogue, and every column is a fixed index of that array seen through its type's cast.

The only unbounded step, choosing the latest row of each cell, is a combinable aggregate (``max_by``), so an entity that
holds a third of all rows reaches the shuffle as at most one row per attribute and map task. Nothing is collected but the
catalogue, which is the target schema.

Defined cases: a null entity is an entity of its own (one row with a null id); null attribute names belong to no
column; of rows with the same cell and time the greatest value counts, a null least; a null time is earlier than all
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for "no value".
PLACEHOLDERS = ("-", "--", "n.d.", "nd", "n/a", "na", "null", "none")
#: Month names by their first letters, Italian and English.
MONTHS = ("gen|jan", "feb", "mar", "apr", "mag|may", "giu|jun", "lug|jul", "ago|aug", "set|sep", "ott|oct", "nov", "dic|dec")
TRUE = ("true", "t", "yes", "y", "si", "sì", "s", "1", "vero", "v")
FALSE = ("false", "f", "no", "n", "0", "falso")
SPACE = r"[\s\p{Z}\x{FEFF}\x{200B}]"
TYPES = ("text", "int", "decimal", "date", "bool")


def attribute_key(name: Column) -> Column:
    """Attribute names are one if their letters and digits are, whatever the case and the separators."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def cleaned(value: Column) -> Column:
    """Trimmed text; null where it is blank or a placeholder."""
    text = F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")
    return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS), text)


def int_text(text: Column) -> Column:
    """Digits of a whole number that has a sign, leading zeros, zero decimals or grouped thousands."""
    whole = F.regexp_replace(text, r"[.,]0{1,2}$", "")
    return F.when(whole.rlike(r"^[+-]?\d{1,3}([.,' ]\d{3})+$|^[+-]?\d{1,18}$"), F.regexp_replace(whole, r"[.,' ]", ""))


def decimal_text(text: Column) -> Column:
    """Plain notation of a number with either decimal sign, grouped thousands, a currency or a unit of weight.

    One sign groups throughout and another one separates the decimals; a lone sign before three digits groups.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^(?:€|eur)[\s\p{Z}]*|[\s\p{Z}]*(?:€|eur|kg)\.?$", ""), r"[\s\p{Z}’']", "'")
    return (
        F.when(bare.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$"), F.translate(bare, ",.", "."))
        .when(bare.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.translate(bare, ",", ""))
        .when(bare.rlike(r"^[+-]?\d{1,3}('\d{3})+([.,]\d+)?$|^[+-]?\d+([.,]\d+)?$"), F.translate(bare, ",'", "."))
    )


def date_text(text: Column) -> Column:
    """yyyy-M-d of a date: year-month-day (also with a time), day-month-year in numbers or with the month's name; yy is 20yy."""
    out = F.lower(text)
    for pattern, order in (
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t ].*)?$", "$1-$2-$3"),
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[t ]\d{1,2}:.*)?$", "$3-$2-$1"),
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})$", "20$3-$2-$1"),
        (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
        (r"^(\d{1,2})[°º.]?\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})$", "$3-$2-$1"),
        (r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$", "$3-$1-$2"),
    ):
        out = F.regexp_replace(out, pattern, order)
    for i, names in enumerate(MONTHS):
        out = F.regexp_replace(out, f"-(?:{names})-", f"-{i + 1}-")
    return F.when(out.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), out)


def bool_text(text: Column) -> Column:
    low = F.replace(F.lower(text), F.lit("i\u0300"), F.lit("ì"))
    return F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false")


def plain_text(text: Column, kind: Column) -> Column:
    """A cleaned value in the notation that its type's try cast reads; null where it is not of the type."""
    return F.when(kind == "text", text).when(kind == "int", int_text(text)).when(kind == "decimal", decimal_text(text)).when(kind == "date", date_text(text)).when(kind == "bool", bool_text(text))


def cast_cell(text: Column, kind: str) -> Column:
    if kind == "decimal":
        return F.round(text.try_cast("decimal(38,10)"), 2).try_cast("decimal(28,2)")
    return text if kind == "text" else text.try_cast({"int": "bigint", "date": "date", "bool": "boolean"}[kind])


def written(cell: Column, kind: str) -> Column:
    """A typed cell as text: digits, two places and a point, yyyy-MM-dd, true or false."""
    return F.date_format(cell, "yyyy-MM-dd") if kind == "date" else cell.cast("string")


def latest_cells(df: DataFrame, catalog: list[tuple[str, str]], entity: str, attribute: str, value: str, at: str) -> DataFrame:
    """(entity, pos, raw): the latest value of each cell; pos -1 keeps the entities that have no column of the catalogue."""
    where = F.create_map(*[x for i, (name, _) in enumerate(catalog) for x in (F.lit("".join(c for c in name.lower() if c.isalnum())), F.lit(i))])
    rows = df.select(F.col(entity).alias("_entity"), F.coalesce(where[attribute_key(F.col(attribute))], F.lit(-1)).alias("_pos"), F.col(value).cast("string").alias("_value"), F.col(at).alias("_at"))
    return rows.groupBy("_entity", "_pos").agg(F.max_by("_value", F.struct("_at", "_value")).alias("_raw"))


def widen(df: DataFrame, catalog: DataFrame | list[tuple[str, str]], entity: str = "document_id", attribute: str = "field_name", value: str = "value_text", at: str = "loaded_at") -> DataFrame:
    """One row per entity with the typed columns of the catalogue (field_name, value_type), in its order."""
    columns = [(r[0], r[1]) for r in catalog.select("field_name", "value_type").collect()] if isinstance(catalog, DataFrame) else list(catalog)
    if bad := {kind for _, kind in columns} - set(TYPES):
        raise ValueError(f"unknown types {sorted(bad)}")
    cells = latest_cells(df, columns, entity, attribute, value, at)
    grid = cells.select("_entity").distinct().select("_entity", F.explode(F.array(*[F.lit(i) for i in range(len(columns))])).alias("_pos"))
    filled = grid.alias("g").join(cells.alias("c"), F.col("g._entity").eqNullSafe(F.col("c._entity")) & (F.col("g._pos") == F.col("c._pos")), "left")
    texts = filled.select(F.col("g._entity").alias(entity), F.col("g._pos").alias("pos"), cleaned(F.col("c._raw")).alias("text"))
    kinds = F.array(*[F.lit(kind) for _, kind in columns])
    plain = texts.select(entity, F.struct("pos", plain_text(F.col("text"), kinds[F.col("pos")]).alias("text")).alias("cell"))
    wide = plain.groupBy(entity).agg(F.array_sort(F.collect_list("cell")).alias("_cells"))
    return wide.select(entity, *[cast_cell(F.col("_cells")[i]["text"], kind).alias(name) for i, (name, kind) in enumerate(columns)])


def cells_of(wide: DataFrame, catalog: list[tuple[str, str]], entity: str = "document_id") -> DataFrame:
    """The non-null cells of a wide table: (entity, field_name, typed_value)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field_name"), written(F.col(name), kind).alias("typed_value")) for name, kind in catalog])
    return wide.select(entity, F.explode(F.filter(pairs, lambda c: c["typed_value"].isNotNull())).alias("c")).select(entity, "c.field_name", "c.typed_value")
