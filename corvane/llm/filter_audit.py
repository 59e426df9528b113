"""What filters do to one another (operator 12).

Native expressions give each document a mask of the filters it fails, and a grouping by text the smallest id of each
text. Masks are counted in 32 cells per part; every order of the filters is then read off the cells, not the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, table

LETTERS = "ABCDE"


def failures(text: Column, words: Column) -> list[Column]:
    """Conditions A to D, which need the document alone: few words, few distinct words, many capitals, odd characters."""
    n, chars = F.size(words), F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, UPPER, ""))
    return [n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > chars * 10, text.rlike("[#$%&*|]")]


def _mask(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for k, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, 1 << k).otherwise(0))
    return out


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: _id, part, mask (bit k set: it fails filter k of ABCDE).

    Null texts and parts count as empty. E: some smaller id has the same text, whatever its part. A null id is smaller
    than none and larger than none, so that row never fails E and makes no other fail; rows that share text and id
    don't fail for each other. Words are runs of anything but ASCII white space, whole texts are read, however long.

    The grouping by text moves each distinct text of a task once, with a running minimum; a text that a third of all
    rows hold is one row per task. What joins its result is an id and a hash of the text beside it: the hash only tells
    rows apart that repeat an id with another text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    key = F.xxhash64("_text", F.octet_length("_text"))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    own = rows.withColumn("_words", words).select("_id", "part", key.alias("_key"), _mask(failures(F.col("_text"), F.col("_words"))).alias("_own"))
    first = rows.groupBy("_text").agg(F.min("_id").alias("_first")).filter("_first IS NOT NULL").select("_first", key.alias("_of"), F.lit(True).alias("_is_first"))
    both = own.join(first, (F.col("_id") == F.col("_first")) & (F.col("_key") == F.col("_of")), "left")
    repeated = F.col("_id").isNotNull() & F.col("_is_first").isNull()
    return both.select("_id", "part", F.col("_own").bitwiseOR(F.when(repeated, 16).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: 32 rows a part at most. labels with several rows for an id count as good or toxic if one of them does; null and unknown ids have no label."""
    by_id = labels.groupBy(F.col(id_col).alias("_labelled")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    both = masks.join(by_id, F.col("_id") == F.col("_labelled"), "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))


def filter_orders(cells: DataFrame) -> DataFrame:
    """Each part's cells read in all 120 orders of the filters: one row per part, order and step.

    A part is one row with an array of its cells (32 at most), so orders multiply the parts and not the documents.
    An empty table of cells gives no rows.
    """
    orders = F.split(F.lit(",".join(map("".join, permutations(LETTERS)))), ",")
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = per_part.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def bits(which) -> Column:
        return _mask([which(F.instr("filter_order", letter)) for letter in LETTERS])

    seen = steps.select("*", bits(lambda at: at < F.col("step")).alias("before"), bits(lambda at: at == F.col("step")).alias("own"))

    def total(holds, value=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(holds(c["mask"]), value(c)).otherwise(0))

    before, own = F.col("before"), F.col("own")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~gone(m)
    return seen.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in the same share of the orders.
        total(fails, lambda c: c["n"] * F.call_function("div", F.lit(120).cast("long"), F.bit_count(c["mask"]).cast("long"))).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents through failure_masks() and mask_cells() with the table of labels; see filter_orders() for the rows."""
    return filter_orders(mask_cells(failure_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
    'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > first_id, false)} AS f
  FROM w LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
e AS (
  SELECT part, filter_order, step, n, good, toxic,
    [f['A'], f['B'], f['C'], f['D'], f['E']] AS fs,
    list_transform(string_split(filter_order, ''), lambda x: CASE x WHEN 'A' THEN f['A'] WHEN 'B' THEN f['B'] WHEN 'C' THEN f['C'] WHEN 'D' THEN f['D'] ELSE f['E'] END) AS g
  FROM c, s
),
r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
    sum(n) FILTER (WHERE NOT list_contains(g[:step], true)) AS kept,
    sum(n) FILTER (WHERE g[step] AND NOT list_contains(g[:step - 1], true)) AS removed,
    sum(n) FILTER (WHERE g[step] AND list_contains(g[:step - 1], true)) AS redundant,
    sum(n) FILTER (WHERE g[step] AND len(list_filter(g, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (WHERE g[step] AND NOT list_contains(g[:step - 1], true)) AS good_lost,
    sum(toxic) FILTER (WHERE g[step] AND NOT list_contains(g[:step - 1], true)) AS toxic_lost
  FROM e GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""
