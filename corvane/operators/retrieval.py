"""Which chunks a question may retrieve, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import question_filters
from .vectors import best_within, rank_hits, top_k

MODES = ("baseline", "source_filter", "question_filter")


def plan(questions: DataFrame, mode: str, selected_years: list[int]) -> DataFrame:
    """questions with detected_year, detected_month (reported) and year, month, date_pairs (filtered by).

    baseline reports what the question names and filters by nothing. source_filter filters by the answer key's own
    dates: an upper bound, since hits are judged by those dates too. question_filter filters by what the question
    names, which is what a user without an answer key can do.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    seen = question_filters(F.col("question"), selected_years)
    none = F.lit(None).cast("int")
    no_pairs = F.array().cast("array<struct<year:int,month:int>>")
    out = questions.withColumn("_seen", seen)
    year, month = F.col("_seen.year"), F.col("_seen.month")
    if mode == "source_filter":
        known = F.coalesce(F.col("row_year"), year)
        cols = {"detected_year": known, "detected_month": F.col("row_month"), "year": known, "month": F.col("row_month"), "date_pairs": F.coalesce("source_date_pairs", no_pairs)}
    elif mode == "question_filter":
        cols = {"detected_year": year, "detected_month": month, "year": year, "month": month, "date_pairs": no_pairs}
    else:
        cols = {"detected_year": year, "detected_month": month, "year": none, "month": none, "date_pairs": no_pairs}
    return out.withColumns(cols).drop("_seen")


def matches(pairs: Column, year: Column, month: Column, chunk_year: Column, chunk_month: Column) -> Column:
    """A set of pairs overrides year and month; of those each that is given must match; nothing given: every chunk."""
    here = F.exists(pairs, lambda p: (p["year"] == chunk_year) & (p["month"] == chunk_month))
    given = (year.isNull() | (chunk_year == year)) & (month.isNull() | (chunk_month == month))
    return F.when(F.size(pairs) > 0, here).otherwise(given)


def retrieve(plans: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, rank, pos, score of each plan's k best chunks; plans without a matching chunk have no rows.

    plans: query_id, vector, year, month, date_pairs. chunks: pos, vector, year, month. Disjoint arms: filtered
    questions meet only the chunks that agree with them on what they filter by (pairs or year and month, year alone,
    month alone), unfiltered ones all chunks. Each arm is matrix products over blocks.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    p = plans.select("query_id", "vector", F.col("year"), F.col("month"), F.coalesce("date_pairs", F.array().cast("array<struct<year:int,month:int>>")).alias("pairs"))
    c = chunks.select("pos", "vector", "year", "month")
    paired = F.size("pairs") > 0
    each = p.filter(paired).select("query_id", "vector", F.explode(F.array_distinct("pairs")).alias("d")).select("query_id", "vector", "d.year", "d.month")
    rest = p.filter(~paired)
    dated = rest.filter("year IS NOT NULL AND month IS NOT NULL").select("query_id", "vector", "year", "month")
    found = best_within(each.unionByName(dated), c, ["year", "month"], k)
    found = found.unionByName(best_within(rest.filter("year IS NOT NULL AND month IS NULL"), c, ["year"], k))
    found = found.unionByName(best_within(rest.filter("year IS NULL AND month IS NOT NULL"), c, ["month"], k))
    every = top_k(rest.filter("year IS NULL AND month IS NULL"), c, k).select("query_id", "pos", "score")
    return rank_hits(found.unionByName(every), k)
