"""Year and month expressions: pairs in texts, question filters, what a row's pairs come to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations in the order in which they are looked for.
MONTH_NAMES = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
# What counts as a year and as a month in numbers.
YEAR = r"(?:19|20)\d{2}"
MONTH = r"1[0-2]|0?[1-9]"
PAIRS = "array<struct<year:int,month:int>>"


def _found(text: Column, pattern: Column, year_group: int, month: Column | int) -> Column:
    """Pairs of all matches, in the order of the text; month is a group of the pattern, or a Column."""
    get = lambda g: F.transform(F.regexp_extract_all(text, pattern, F.lit(g)), lambda x: x.cast("int"))
    if isinstance(month, int):
        return F.zip_with(get(year_group), get(month), lambda y, m: F.struct(y.alias("year"), m.alias("month")))
    return F.transform(get(year_group), lambda y: F.struct(y.alias("year"), month.alias("month")))


def all_year_months(text: Column) -> Column:
    """All year-month pairs of a text, each once: by pattern first, by place within a pattern.

    Numeric year-month, numeric month-year, then for each month name: name before year, year before name. Only names
    that are in the text are looked for with their patterns.
    """
    low = F.lower(text)
    numeric = [_found(text, F.lit(rf"(?U)({YEAR})[_\-/.]({MONTH})(?=\D|\z)"), 1, 2), _found(text, F.lit(rf"(?U)(?<!\d)({MONTH})[_\-/.]({YEAR})"), 2, 1)]
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("month")) for n, m in MONTH_NAMES.items()])

    def named(x: Column) -> Column:
        before = F.concat(F.lit(r"(?U)\b"), x["name"], F.lit(rf"\b[^\n\r,;|]*?\b({YEAR})\b"))
        after = F.concat(F.lit(rf"(?U)\b({YEAR})\b[^\n\r,;|]*?\b"), x["name"], F.lit(r"\b"))
        return F.concat(_found(low, before, 1, x["month"]), _found(low, after, 1, x["month"]))

    words = F.flatten(F.transform(F.filter(names, lambda x: F.contains(low, x["name"])), named))
    return F.array_distinct(F.concat(*numeric, words))


def first_year_month(text: Column) -> Column:
    return F.get(all_year_months(text), F.lit(0))


def bare_years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?U)\b({YEAR})\b"), F.lit(1)), lambda y: y.cast("int"))


def summarize_pairs(pairs: Column) -> Column:
    """struct(year, month): the latest year, and the month if all pairs share it; null without pairs.

    One fold, so that pairs (often a costly expression) is evaluated once. Month 0 stands for several months.
    """
    state = lambda y, m: F.struct(y.alias("year"), m.alias("month"))
    none = F.lit(None).cast("int")

    def fold(acc: Column, p: Column) -> Column:
        month = F.when(acc["month"].isNull() | (acc["month"] == p["month"]), p["month"]).otherwise(F.lit(0))
        return state(F.greatest(acc["year"], p["year"]), month)

    return F.aggregate(pairs, state(none, none), fold, lambda a: F.when(a["year"].isNotNull(), state(a["year"], F.nullif(a["month"], F.lit(0)))))


def first_month_name(low: Column) -> Column:
    """The month whose name is in the text; of several the first in the order of names, not of the text."""
    return F.coalesce(*[F.when(low.rlike(rf"(?U)\b{n}\b"), F.lit(m)) for n, m in MONTH_NAMES.items()])


def question_filters(question: Column, selected_years: list[int]) -> Column:
    """struct(year, month) that a question asks for: month/year, year/month, else a year (a selected one first) and a
    month's name; without a year both are null."""
    pattern = {"my": rf"(?U)\b({MONTH})[/\-.](20\d{{2}})\b", "ym": rf"(?U)\b(20\d{{2}})[/\-.]({MONTH})\b"}
    pick = lambda p, y, m: F.when(question.rlike(p), F.struct(F.regexp_extract(question, p, y).cast("int").alias("year"), F.regexp_extract(question, p, m).cast("int").alias("month")))
    years = F.transform(F.regexp_extract_all(question, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    chosen = F.filter(years, lambda y: y.isin([int(x) for x in selected_years]))
    year = F.coalesce(F.get(chosen, F.lit(0)), F.get(years, F.lit(0)))
    words = F.struct(year.alias("year"), F.when(year.isNotNull(), first_month_name(F.lower(question))).alias("month"))
    return F.coalesce(pick(pattern["my"], 2, 1), pick(pattern["ym"], 1, 2), words)


def row_year_month(question: Column, source_pairs: Column, year: Column | None = None, month: Column | None = None) -> Column:
    """struct(year, month) of an answer-key row: its own year and month, else its sources', else the question's pairs,
    else the least bare year of the question; a row with none of these is an error, as is a month out of range."""
    none = F.lit(None).cast("struct<year:int,month:int>")
    own = none
    if year is not None:
        m = month if month is not None else F.lit(None).cast("int")
        checked = F.when(m.isNull() | m.between(1, 12), m).otherwise(F.raise_error(F.concat(F.lit("month out of range: "), m.cast("string"))).cast("int"))
        own = F.when(year.isNotNull(), F.struct(year.cast("int").alias("year"), checked.cast("int").alias("month")))
    bare = bare_years(question)
    least = F.when(F.size(bare) > 0, F.struct(F.array_min(bare).alias("year"), F.lit(None).cast("int").alias("month")))
    error = F.raise_error(F.concat(F.lit("no year for question: "), F.coalesce(question, F.lit("")))).cast("struct<year:int,month:int>")
    return F.coalesce(own, summarize_pairs(source_pairs), summarize_pairs(all_year_months(question)), least, error)


def source_date_pairs(source_pairs: Column, year: Column, month: Column) -> Column:
    """A row's own source pairs, else its year and month if it has a month, else none."""
    one = F.array(F.struct(year.cast("int").alias("year"), month.cast("int").alias("month")))
    return F.when(F.size(source_pairs) > 0, F.array_distinct(source_pairs)).when(month.isNotNull(), one).otherwise(F.array().cast(PAIRS))


