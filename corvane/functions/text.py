"""Text expressions: every function takes and returns a Column, so all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 characters that count as white space.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: White space but the space: a single space, which most runs are, is left where it is when runs are replaced.
_NOT_SPACE = WS.replace(r"\x1c-\x20", r"\x1c-\x1f")
#: Where a text has line boundaries other than the line feed too.
LINE_ENDS = r"[\n\x0b\x0c\x1c-\x1e\x85  ]"
#: The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMBER = r"(?U)[-+]?\$?\d[\d,]*(?:\.\d+)?%?"
NUMERIC_TOKEN = r"(?U)[$-]?\d[\d,]*(?:\.\d+)?%?"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it: bound as a lambda's variable.

    The optimizer merges projections and copies an expression into a lambda that uses it, where it would be evaluated
    for each element.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.btrim(F.regexp_replace(c, f" {WS}+|{_NOT_SPACE}{WS}*", " "), F.lit(" "))


def tokens(c: Column) -> Column:
    """White-space tokens; none for a blank text."""
    return F.filter(F.split(collapse(c), " "), lambda t: t != "")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clip(c: Column, n: int | Column) -> Column:
    """The first n code points."""
    return F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def normalize_answer(c: Column) -> Column:
    """Lower case, punctuation deleted without a space in its place, white space collapsed."""
    return collapse(F.translate(F.lower(c), PUNCTUATION, ""))


def numbers(c: Column) -> Column:
    """Numbers of a text as doubles; signs count, currency, thousands and per cent marks don't."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.array_compact(F.transform(found, lambda x: F.translate(x, "$,%", "").try_cast("double")))


def numeric_token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NUMERIC_TOKEN))


def sentences(c: Column) -> Column:
    """Non-empty sentences, collapsed: split after . ! ? before white space, and at line feeds."""
    parts = F.transform(F.split(c, rf"(?<=[.!?]){WS}+|\n+"), collapse)
    return F.filter(parts, lambda s: s != "")


def terms(c: Column, longer_than: int = 0) -> Column:
    """Distinct lower-cased ASCII words of more than longer_than characters."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > longer_than))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def has_citation(c: Column) -> Column:
    return c.rlike(r"\[S\d+\]")


def year_month(year: Column, month: Column) -> Column:
    """YYYY-MM, with a phrase for what is missing."""
    return F.concat_ws("-", F.coalesce(year.cast("string"), F.lit("unknown year")), F.coalesce(F.lpad(month.cast("string"), 2, "0"), F.lit("unknown month")))


def citation(fields: list[str], get) -> Column:
    """Fields joined by " | "; get(name) gives each one's Column. year_month is made of year and month."""
    parts = [year_month(get("year"), get("month")) if f == "year_month" else F.coalesce(get(f).cast("string"), F.lit(f"unknown {f}")) for f in fields]
    return F.concat_ws(" | ", *parts)


def json_value(c: Column, schema: str) -> Column:
    """Parsed JSON of that type; null where it can't be parsed."""
    return F.from_json(c, schema)


def json_object(c: Column) -> Column:
    """A text's JSON object: the text itself, else what lies between its first { and its last }; else null."""
    whole, inner = c, F.regexp_extract(c, r"(?s)\{.*\}", 0)
    is_object = lambda x: F.get_json_object(x, "$").isNotNull() & F.btrim(x).startswith("{")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def is_missing(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "NaN")
