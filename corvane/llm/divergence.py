"""How the words of sources differ (operator 11).

For each pair of a language's sources the value is a sum over all kept terms, most of which neither source has. Each
pair starts at V times the value of two zero counts; postings of terms then emit what is not zero of the difference.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise, small_batches, table, text_slices

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: In UTF-8, where characters beyond ASCII are bytes from 0x80 on; bytes.lower() knows A-Z only.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms that a task counts before it sends them on; bytes of a text beyond which its terms aren't listed at once, and how many are.
HELD, LONG, AT_ONCE = 500_000, 1_000_000, 100_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), in decimals: SCALE times a count of a large corpus is beyond 64 bits."""
    return _div((count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), (n + v).cast("decimal(28,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are SCALE + 1 at most, so the square fits 64 bits."""
    return _div((p - q) * (p - q), q)


def _count(batches):
    """Counts of a task's rows by language, source and term, sent on whenever HELD of them have come together."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent():
        for (lang, source), (n, docs) in held.items():
            if n:
                columns = [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source), len(n)), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in text_slices(batches):
        for text, lang, source in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), b.column("source").to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            if len(text) <= LONG:
                n.update(found := _TERM.findall(text.lower()))
                docs.update(set(found))
                continue
            found, seen = _TERM.finditer(text.lower()), set()
            while some := [m.group() for m in islice(found, AT_ONCE)]:
                n.update(some)
                seen.update(some)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) >= HELD:
            yield from sent()
    yield from sent()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it). Null columns count as empty; every row counts as a document.

    Rows are counted in their task first: a group with a third of all rows, or a term in all of them, sends one row per
    task and term (or a few, as a task holds HELD terms at most).
    """
    small_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(text_col).alias("text"), empty(lang_col).alias("lang"), empty(source_col).alias("source"))
    each = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Counted already, rows hardly shrink before the shuffle; dealt by language and term they needn't move again for a term's sources.
    return each.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows against each other source, `term` rows of the top terms.

    Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. A language keeps the terms that at
    least min_docs of its rows hold. Groups without a kept term take part (their counts are zero), a language's only
    source has no pairs, an empty table gives no rows, repeated rows count each, other columns are ignored. Ties rank by
    the item's UTF-8 bytes.

    With A and B the terms of two sources, the sum over all V terms is V f(0, 0), plus f(a, 0) - f(0, 0) over A, plus
    f(0, b) - f(0, 0) over B, plus f(a, b) - f(a, 0) - f(0, b) + f(0, 0) over what both have. The middle two depend on a
    term by its count only, so they are summed over each source's different counts; only a term's own sources meet in
    pairs. Posting lists and lists of groups are bounded by a language's sources, whose pairs are the result.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    kept = materialise(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("_docs"), F.collect_list(F.struct("source", "n")).alias("postings")).filter(F.col("_docs") >= min_docs).drop("_docs"),
        "divergence-kept",
    )
    groups = _groups(docs, kept, lang_col, source_col)
    posting = kept.select("lang", "term", "total", F.inline("postings")).join(groups, ["lang", "source"])
    scored = posting.select("lang", "source", "term", _p(F.col("n"), F.col("size"), F.col("v")).alias("p"), "p0", _p(F.col("total"), F.col("lang_size"), F.col("v")).alias("q"))
    scored = materialise(scored, "divergence-scored")
    drop_table(kept)
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top)
    pairs = _pairs(scored, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_group))
    return pairs.unionByName(terms)


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, size (its occurrences of kept terms), v, lang_size, p0 (its p of a zero count), for every group that occurs."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = kept.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    every = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("size"), zero("v"), zero("lang_size"))
    # Without kept terms nothing is divided; p0 is then only multiplied by V = 0.
    return materialise(out.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("size"), F.col("v"))).otherwise(1)), "divergence-groups")


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value."""
    others = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("p0").alias("r0"))).alias("others"))
    apart = F.col("source") != F.col("item")
    p, p0, r, r0 = (F.col(c) for c in ("p", "p0", "r", "r0"))
    start = groups.join(others, "lang").select("lang", "source", "p0", "v", F.inline("others")).filter(apart)
    start = start.select("lang", "source", "item", (F.col("v") * _f(p0, r0)).alias("value"))
    # One source has the term: by count, in both directions.
    by_count = scored.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k")).join(others, "lang")
    single = by_count.select("lang", "source", "p", "p0", "k", F.inline("others")).filter(apart)
    side = lambda a, b, value: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), (F.col("k") * value).alias("value"))
    sides = F.array(side("source", "item", _f(p, r0) - _f(p0, r0)), side("item", "source", _f(r0, p) - _f(r0, p0)))
    single = single.select("lang", F.inline(sides)).filter("value != 0")
    # Both have it.
    lists = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("a")).filter(F.size("a") > 1)
    second = F.col("a").cast("array<struct<item:string,r:bigint,r0:bigint>>")
    shared = lists.select(second.alias("b"), "lang", F.inline("a")).select("lang", "source", "p", "p0", F.inline("b")).filter(apart)
    shared = shared.select("lang", "source", "item", (_f(p, r) - _f(p, r0) - _f(p0, r) + _f(p0, r0)).alias("value")).filter("value != 0")
    return start.unionByName(single).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents; see source_divergence() for the rows and for what nulls, ties and empty groups give."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
e AS (SELECT doc_id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM e GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM kept GROUP BY lang),
c AS (SELECT e.lang, e.source, e.term, count(*)::HUGEINT AS n FROM e JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (l.size + l.v) AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
