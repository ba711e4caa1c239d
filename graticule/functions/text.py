"""Column builders for keys, tokens and similarity; all stay inside generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of texts.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
TOKEN_BREAK = r"[\s\-_:.,;/\\]+"


@dataclass(frozen=True)
class Settings:
    """How values are compared."""

    ignore_whitespace: bool = True
    case_sensitive: bool = False
    normalize_dashes: bool = True
    skip_empty: bool = True
    partial: bool = True
    threshold: float = 0.5


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(SPACES))


def normalized(c: Column, s: Settings = Settings()) -> Column:
    """A value as key: trimmed, lower-cased, runs of blanks, dashes and underscores as one dash, none at the ends."""
    out = trimmed(F.coalesce(c, F.lit("")))
    out = out if s.case_sensitive else F.lower(out)
    if s.normalize_dashes:
        return F.regexp_replace(F.regexp_replace(out, r"(?U)[\s\-_]+", "-"), r"-$|^-", "")
    return F.regexp_replace(out, r"(?U)\s+", " ") if s.ignore_whitespace else out


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_BREAK), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def compose(columns: list[Column], separator: str = "-") -> Column:
    """Several columns as one value, blank ones left out, the others as they are."""
    if len(columns) == 1:
        return F.coalesce(columns[0], F.lit(""))
    return F.concat_ws(separator, F.filter(F.array(*columns), lambda x: trimmed(F.coalesce(x, F.lit(""))) != ""))


def values_match(a: Column, b: Column, s: Settings = Settings()) -> Column:
    x, y = normalized(a, s), normalized(b, s)
    same = (F.contains(x, y) | F.contains(y, x)) if s.partial else (x == y)
    return F.when((x == "") | (y == ""), F.lit(True)).otherwise(same) if s.skip_empty else same


def code_prefix(c: Column, prefix: str) -> Column:
    """Non-blank values that begin with the prefix, whatever the case."""
    text = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    return (text != "") & text.startswith(prefix.strip().lower())


def round_half_up(c: Column) -> Column:
    """Nearest whole number, halves upwards (-2.5 gives -2)."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def identifier(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9]", "_")


def unfenced(c: Column) -> Column:
    """JSON without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def web_path(c: Column) -> Column:
    return F.regexp_replace(c, r"^/dataai/", "/files/")


def csv_cell(c: Column, kind: str) -> Column:
    """A cell as JSON text; null, zero, false and the empty text are "" alike."""
    falsy = c.isNull() | ((c == 0) if kind in ("int", "bigint", "double", "smallint") or kind.startswith("decimal") else (~c) if kind == "boolean" else (c == ""))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.coalesce(falsy, F.lit(True)), F.lit('""')).otherwise(quoted if kind == "string" else c.cast("string"))


def capitalised(c: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def percent(c: Column) -> Column:
    """A share of 100 as a whole number from 0 to 100."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(100).cast("bigint"), round_half_up(c)))


def template(text: str, values: dict[str, Column]) -> Column:
    """A text with {name} replaced by the values; unknown names stay."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def url(base: Column, path: Column, params: dict[str, Column]) -> Column:
    """Base and path with the encoded parameters that have a value."""
    query = F.concat_ws("&", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in params.items()])
    whole = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
    return F.when(query == "", whole).otherwise(F.concat(whole, F.lit("?"), query))


def url_parameter(c: Column, name: str) -> Column:
    return F.try_parse_url(c, F.lit("QUERY"), F.lit(name))


def tag_list(c: Column) -> Column:
    """Comma-separated tags, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trimmed), lambda t: t != "")


def command_line(c: Column) -> Column:
    """A list of words as one text."""
    return F.array_join(c, " ")


def first_text(c: Column) -> Column:
    """The first value of a JSON object that is a text."""
    texts = F.filter(F.map_values(F.from_json(c, "map<string,variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    return F.try_variant_get(F.get(texts, F.lit(0)), "$", "string")
