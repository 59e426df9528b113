"""The catalogue: one query for each operator, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import dates, judging, matching, text
from ..operators import answering, blocks, chunking, containment, evaluation, retrieval, vectors
from ..sources.readers import spread
from ..sources.scratch import scratch
from . import pipelines
from .registry import ORACLES, QUERIES, query  # noqa: F401  this module fills them

SIZE, OVERLAP, K, BUDGET = 512, 50, 5, 1000
YEARS = [2006, 2009]

def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(t(spark, sf, name))


# ---------------------------------------------------------------- SQL fragments

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCT = text.PUNCTUATION.replace("'", "''")


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _norm(c: str) -> str:
    return _collapse(f"translate(lower({c}), '{PUNCT}', '')")


def _numbers(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[-+]?\\$?\\d[\\d,]*(?:\\.\\d+)?%?'), lambda x: TRY_CAST(translate(x, '$,%', '') AS DOUBLE)), lambda x: x IS NOT NULL)"


def _tokens(c: str) -> str:
    return f"list_filter(string_split({_collapse(c)}, ' '), lambda x: x <> '')"


def _numeric(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[$-]?\\d[\\d,]*(?:\\.\\d+)?%?'))"


_LINES = f"""
raw AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, {_strip("unnest(ls)")} AS line FROM raw),
lc AS (SELECT *, {_collapse("ltrim(line, '#')")} AS compact FROM ln),
lh AS (
  SELECT doc_id, line_no, line, CASE
    WHEN regexp_matches(line, '^#{{1,6}}{WS}+(.+?){WS}*$') THEN {_collapse(f"regexp_extract(line, '^#{{1,6}}{WS}+(.+?){WS}*$', 1)")}
    WHEN compact = '' OR length(compact) > 180 THEN NULL
    WHEN regexp_matches(compact, '(?i)^(?:table|chart|schedule){WS}+[A-Z0-9IVXLC\\-.]+\\b') THEN compact
    WHEN NOT regexp_matches(compact, '[.,;:]$') AND {_numeric("compact")} <= 1
      AND length(regexp_replace(compact, '[^\\p{{L}}]', '', 'g')) > 0
      AND length(regexp_replace(compact, '[^\\p{{Lu}}]', '', 'g')) >= 0.75 * length(regexp_replace(compact, '[^\\p{{L}}]', '', 'g'))
      AND len(string_split(compact, ' ')) BETWEEN 1 AND 14 THEN compact END AS heading
  FROM lc
)"""
_TABLE_LINE = f"(regexp_matches(x, '[^\\s]{WS}{{2,}}[^\\s]') AND {_numeric('x')} >= 3)"
_BLOCKS = f"""{_LINES},
lb AS (
  SELECT *, sum(CASE WHEN line = '' OR heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp,
    coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Document') AS running
  FROM lh
),
gb AS (
  SELECT doc_id, grp, max(running) AS heading, string_agg(coalesce(heading, line), chr(10) ORDER BY line_no) AS block
  FROM lb WHERE line <> '' GROUP BY doc_id, grp
),
blocks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS i, heading, block,
    CASE WHEN len(list_filter(string_split(block, chr(10)), lambda x: x <> '')) >= 2
      AND len(list_filter(string_split(block, chr(10)), lambda x: {_TABLE_LINE})) >= 2 THEN 'table' ELSE 'text' END AS content_type,
    {_tokens("block")} AS words
  FROM gb
)"""
_STEP = SIZE - OVERLAP
_PACK = f"""{_BLOCKS},
sized AS (SELECT doc_id, i, len(words)::INT AS n, content_type = 'table' AS tab FROM blocks),
packed AS (
  SELECT doc_id, 0 AS i, 0 AS a, 0 AS e, 0 AS b, FALSE AS t, CAST([] AS STRUCT(s INT, e INT, b INT, t BOOLEAN)[]) AS out FROM documents
  UNION ALL
  SELECT p.doc_id, p.i + 1,
    CASE WHEN x.n > {SIZE} THEN p.e + x.n WHEN p.a = p.e THEN p.a WHEN p.e - p.a + x.n > {SIZE} THEN p.e - least({OVERLAP}, p.e - p.a) ELSE p.a END,
    p.e + x.n,
    CASE WHEN x.n > {SIZE} OR p.a = p.e OR p.e - p.a + x.n > {SIZE} THEN x.i ELSE p.b END,
    CASE WHEN x.n > {SIZE} OR p.a = p.e THEN x.tab ELSE p.t OR x.tab END,
    CASE WHEN x.n > {SIZE} THEN list_concat(
        list_concat(p.out, CASE WHEN p.a < p.e THEN [{{'s': p.a, 'e': p.e, 'b': p.b, 't': p.t}}] ELSE [] END),
        list_transform(range(CAST(ceil((x.n - {SIZE}) / {_STEP}.0) AS INT) + 1), lambda j: {{'s': (p.e + j * {_STEP})::INT, 'e': (p.e + least(j * {_STEP} + {SIZE}, x.n))::INT, 'b': x.i, 't': x.tab}}))
      WHEN p.a < p.e AND p.e - p.a + x.n > {SIZE} THEN list_append(p.out, {{'s': p.a, 'e': p.e, 'b': p.b, 't': p.t}})
      ELSE p.out END
  FROM packed p JOIN sized x ON x.doc_id = p.doc_id AND x.i = p.i
),
total AS (SELECT doc_id, count(*)::INT AS n FROM blocks GROUP BY doc_id),
done AS (
  SELECT p.doc_id, CASE WHEN p.a < p.e THEN list_append(p.out, {{'s': p.a, 'e': p.e, 'b': p.b, 't': p.t}}) ELSE p.out END AS out
  FROM packed p JOIN total n ON n.doc_id = p.doc_id AND n.n = p.i
),
ch AS (SELECT doc_id, unnest(range(len(out)))::INT AS chunk_no, unnest(out) AS c FROM done)"""


def _rows(sf_docs: DataFrame, col, name: str) -> DataFrame:
    return sf_docs.select("doc_id", F.posexplode(col).alias(name, "x"))


# ---------------------------------------------------------------- scans, filters, counts


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))")
def doc_counts_by_lang_source(spark, sf):
    return t(spark, sf, "documents").groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def doc_filter_isin(spark, sf):
    return t(spark, sf, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY GROUPING SETS ((y), (y, m))")
def order_counts_by_year_month(spark, sf):
    o = t(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return o.groupingSets([["y"], ["y", "m"]], "y", "m").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- dates


@query(r"""
WITH e AS (SELECT event_id, 'log_' || strftime(ts, '%Y_%m') || '_' || event_type || '.txt' AS path FROM events)
SELECT event_id, regexp_extract(path, '((?:19|20)\d{2})[_\-/.](1[0-2]|0?[1-9])(?:\D|$)', 1)::INT AS year,
  regexp_extract(path, '((?:19|20)\d{2})[_\-/.](1[0-2]|0?[1-9])(?:\D|$)', 2)::INT AS month FROM e""")
def extract_year_month_numeric(spark, sf):
    path = F.concat(F.lit("log_"), F.date_format("ts", "yyyy_MM"), F.lit("_"), F.col("event_type"), F.lit(".txt"))
    ym = dates.first_year_month(path)
    return t(spark, sf, "events").select("event_id", ym["year"].alias("year"), ym["month"].alias("month"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, 1 AS n FROM orders")
def extract_year_month_names(spark, sf):
    pairs = dates.all_year_months(F.date_format("o_orderdate", "MMMM yyyy"))
    rows = wide(spark, sf, "orders").select("o_orderkey", pairs.alias("p"))
    return rows.select("o_orderkey", F.col("p")[0]["year"].alias("year"), F.col("p")[0]["month"].alias("month"), F.size("p").alias("n"))


def _asked():
    """Ten years after the order, so that the year is of the century that questions are read for."""
    return F.concat(F.lit("What did order "), F.col("o_orderkey").cast("string"), F.lit(" come to in "), F.date_format(F.add_months("o_orderdate", 120), "MMMM yyyy"), F.lit("?"))


_ASKED_SQL = r"""
q AS (SELECT *, 'What did order ' || o_orderkey || ' come to in ' || strftime(o_orderdate + INTERVAL 10 YEAR, '%B %Y') || '?' AS question FROM orders),
y AS (SELECT *, list_transform(regexp_extract_all(question, '\b(20\d{2})\b', 1), lambda v: v::INT) AS ys FROM q),
d AS (SELECT *, coalesce(list_filter(ys, lambda v: v IN (2006, 2009))[1], ys[1]) AS det FROM y)"""


@query(f"WITH {_ASKED_SQL} SELECT o_orderkey, det AS year, CASE WHEN det IS NOT NULL THEN month(o_orderdate)::INT END AS month FROM d")
def question_filters(spark, sf):
    f = dates.question_filters(_asked(), YEARS)
    return t(spark, sf, "orders").select("o_orderkey", f["year"].alias("year"), f["month"].alias("month"))


@query("""SELECT o_custkey, max(year(o_orderdate))::INT AS year, CASE WHEN count(DISTINCT month(o_orderdate)) = 1 THEN min(month(o_orderdate))::INT END AS month,
  count(DISTINCT (year(o_orderdate), month(o_orderdate)))::INT AS n_pairs FROM orders GROUP BY o_custkey""")
def summarize_pairs(spark, sf):
    pair = F.struct(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(pair).alias("p"))
    s = dates.summarize_pairs(F.array_distinct("p"))
    return g.select("o_custkey", s["year"].alias("year"), s["month"].alias("month"), F.size("p").alias("n_pairs"))


@query(f"""WITH {_ASKED_SQL}, p AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate)::INT END AS ry, CASE WHEN o_orderstatus = 'F' THEN month(o_orderdate)::INT END AS rm FROM d)
SELECT o_orderkey, coalesce(ry, det) AS detected_year, rm AS detected_month, CASE WHEN rm IS NOT NULL AND ry IS NOT NULL THEN 1 ELSE 0 END AS n_pairs FROM p""")
def plan_coalesce(spark, sf):
    ry, rm = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")), F.when(F.col("o_orderstatus") == "F", F.month("o_orderdate"))
    pairs = F.when(ry.isNotNull(), dates.source_date_pairs(F.array().cast(dates.PAIRS), ry, rm))
    q = t(spark, sf, "orders").select("o_orderkey", _asked().alias("question"), ry.alias("row_year"), rm.alias("row_month"), pairs.alias("source_date_pairs"))
    return retrieval.plan(q, "source_filter", YEARS).select("o_orderkey", "detected_year", "detected_month", F.size("date_pairs").alias("n_pairs"))


@query("""SELECT o_orderkey, greatest(year(o_orderdate) + 10, CASE WHEN o_orderkey BETWEEN 1900 AND 2099 THEN o_orderkey ELSE 0 END)::INT AS row_year,
  month(o_orderdate)::INT AS row_month FROM orders""")
def row_dates(spark, sf):
    ym = dates.row_year_month(_asked(), F.array().cast(dates.PAIRS))
    return t(spark, sf, "orders").select("o_orderkey", ym["year"].alias("row_year"), ym["month"].alias("row_month"))


# ---------------------------------------------------------------- text


@query("SELECT doc_id, printf('%d_%02d_%05d', 2000 + doc_id // 1000, (doc_id % 12 + 1)::INT, doc_id) AS chunk_id FROM documents")
def chunk_id_format(spark, sf):
    year, month = (F.lit(2000) + F.floor(F.col("doc_id") / 1000)).cast("int"), (F.col("doc_id") % 12 + 1).cast("int")
    return t(spark, sf, "documents").select("doc_id", chunking.chunk_id(year, month, F.col("doc_id")).alias("chunk_id"))


@query(f"SELECT doc_id, md5({_collapse('text')}) AS digest FROM documents")
def collapse_whitespace(spark, sf):
    return wide(spark, sf, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def normalize_answer(spark, sf):
    return wide(spark, sf, "documents").select("doc_id", F.md5(text.normalize_answer(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len({_numbers('text')})::INT AS n, list_max({_numbers('text')}) AS largest FROM documents")
def number_extract(spark, sf):
    d = wide(spark, sf, "documents").select("doc_id", text.numbers(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").alias("n"), F.array_max("x").alias("largest"))


def _sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '[\\x01\\n]+'), lambda x: {_collapse('x')}), lambda x: x <> '')"


@query(f"WITH s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents) SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def sentence_split(spark, sf):
    d = wide(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def _terms(c: str, longer: int = 0) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > {longer}))"


@query(f"""SELECT a.conv_id, a.turn, len(list_intersect({_terms('a.text', 2)}, {_terms('b.text')}))::INT AS shared
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def term_overlap(spark, sf):
    c = t(spark, sf, "conversations")
    a = c.select("conv_id", "turn", text.terms(F.col("text"), 2).alias("q"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), text.terms(F.col("text")).alias("s"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.overlap(F.col("q"), F.col("s")).alias("shared"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props_parse(spark, sf):
    return t(spark, sf, "events").select("event_id", text.json_value(F.col("props"), "k int")["k"].alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_object_mine(spark, sf):
    said = F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.concat(F.lit("Sure. "), F.col("props"), F.lit("\nThat is all.")))
    return t(spark, sf, "events").select("event_id", F.get_json_object(text.json_object(said), "$.k").cast("int").alias("k"))


@query("SELECT doc_id, 'src/' || source || ' | ' || (2000 + doc_id // 1000) || '-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || ' | unknown heading | ' || doc_id AS citation FROM documents")
def citation_format(spark, sf):
    cols = {"source_path": F.concat(F.lit("src/"), F.col("source")), "year": (F.lit(2000) + F.floor(F.col("doc_id") / 1000)).cast("int"), "month": (F.col("doc_id") % 12 + 1).cast("int"), "heading": F.lit(None).cast("string"), "chunk_id": F.col("doc_id")}
    return t(spark, sf, "documents").select("doc_id", text.citation(answering.METADATA_FIELDS, cols.get).alias("citation"))


# ---------------------------------------------------------------- chunking


@query(f"""WITH w AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
k AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {SIZE} THEN 1 ELSE ceil((len(w) - {SIZE}) / {_STEP}.0)::INT + 1 END AS k FROM w),
u AS (SELECT doc_id, w, unnest(range(k))::INT AS window_no FROM k)
SELECT doc_id, window_no, md5(array_to_string(w[window_no * {_STEP} + 1 : window_no * {_STEP} + {SIZE}], ' ')) AS digest FROM u""")
def token_windows(spark, sf):
    return _rows(wide(spark, sf, "documents"), chunking.token_windows(F.col("text"), SIZE, OVERLAP), "window_no").select("doc_id", "window_no", F.md5("x").alias("digest"))


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, heading FROM lh")
def heading_flags(spark, sf):
    lines = F.transform(F.split(text.newlines(F.col("text")), "\n"), text.strip)
    return _rows(wide(spark, sf, "documents"), lines, "line_no").select("doc_id", "line_no", chunking.heading(F.col("x")).alias("heading"))


@query(f"""WITH {_LINES} SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER ({_TABLE_LINE.replace('x,', 'line,').replace("(x", "(line")})::INT AS n_table, sum({_numeric('line')})::BIGINT AS n_numbers
FROM lh GROUP BY doc_id""")
def table_line_flags(spark, sf):
    lines = F.transform(F.split(text.newlines(F.col("text")), "\n"), text.strip)
    n = F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + text.numeric_token_count(x))
    return wide(spark, sf, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, chunking.is_table_line)).alias("n_table"), n.alias("n_numbers"))


@query(f"WITH {_BLOCKS} SELECT doc_id, i AS block_no, heading, content_type, md5(block) AS digest FROM blocks")
def line_blocks(spark, sf):
    b = _rows(wide(spark, sf, "documents"), chunking.blocks(F.col("text")), "block_no")
    return b.select("doc_id", "block_no", "x.heading", "x.content_type", F.md5("x.text").alias("digest"))


@query(f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk_no, c.s AS s, c.e AS e, c.b AS b, c.t AS is_table FROM ch")
def greedy_pack_intervals(spark, sf):
    d = wide(spark, sf, "documents").select("doc_id", F.transform(chunking.blocks(F.col("text")), lambda b: F.struct(F.size(text.tokens(b["text"])).alias("n"), (b["content_type"] == "table").alias("t"))).alias("b"))
    packed = chunking.pack(F.transform("b", lambda b: b["n"]), F.transform("b", lambda b: b["t"]), SIZE, OVERLAP)
    return _rows(d, packed, "chunk_no").select("doc_id", "chunk_no", "x.s", "x.e", "x.b", F.col("x.t").alias("is_table"))


@query(f"""WITH RECURSIVE {_PACK}, allw AS (SELECT doc_id, flatten(list(words ORDER BY i)) AS w, list(heading ORDER BY i) AS hs FROM blocks GROUP BY doc_id)
SELECT doc_id, chunk_no, hs[c.b + 1] AS heading, CASE WHEN c.t THEN 'table' ELSE 'text' END AS content_type, md5(array_to_string(w[c.s + 1 : c.e], ' ')) AS digest FROM ch JOIN allw USING (doc_id)""")
def chunk_rows(spark, sf):
    docs = wide(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_documents(docs, SIZE, OVERLAP).select("doc_id", "chunk_no", "heading", "content_type", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- vectors and retrieval


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS n FROM embeddings)
SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(list_transform(v, lambda x: x / n * x / n)), 6) AS length FROM n""")
def l2_normalize(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("length"))


def _topk(where: str, extra: str = "") -> str:
    return f"""WITH v AS (SELECT vec_id, label, (vec_id % 12 + 1)::INT AS m, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS pos, round(list_inner_product(q.v, c.v), 6) AS score FROM v q JOIN v c ON {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s)
SELECT query_id, rank::INT AS rank, pos, score FROM r WHERE rank <= {K} {extra}"""


def _chunks(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), F.col("label").alias("year"), (F.col("vec_id") % 12 + 1).cast("int").alias("month"))


def _plans(spark, sf, year=None, month=None, pairs=None):
    none, no_pairs = F.lit(None).cast("int"), F.array().cast(dates.PAIRS)
    pick = lambda c, d: d if c is None else c
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), pick(year, none).alias("year"), pick(month, none).alias("month"), pick(pairs, no_pairs).alias("date_pairs"))


@query(_topk("TRUE"))
def topk_all(spark, sf):
    return retrieval.retrieve(_plans(spark, sf), _chunks(spark, sf), K).select("query_id", "rank", "pos", "score")


@query(_topk("TRUE"))
def topk_blocks(spark, sf):
    """The same rows by way of an index in blocks, of which those are left out that can't hold any of a query's best."""
    path = scratch(spark, "blocks")
    blocks.write_blocks(_chunks(spark, sf).select("pos", "vector"), path, block_rows=256)
    return blocks.top_k_in_blocks(_plans(spark, sf).select("query_id", "vector"), path, K)[0].select("query_id", "rank", "pos", "score")


@query(_topk("q.label = c.label"))
def topk_filtered(spark, sf):
    return retrieval.retrieve(_plans(spark, sf, year=F.col("label")), _chunks(spark, sf), K).select("query_id", "rank", "pos", "score")


@query(_topk("(c.label = q.label AND c.m = q.m) OR (c.label = (q.label + 1) % 10 AND c.m = 1)"))
def topk_pairs(spark, sf):
    pair = lambda y, m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"))
    pairs = F.array(pair(F.col("label"), F.col("vec_id") % 12 + 1), pair((F.col("label") + 1) % 10, F.lit(1)))
    return retrieval.retrieve(_plans(spark, sf, year=F.lit(99), pairs=pairs), _chunks(spark, sf), K).select("query_id", "rank", "pos", "score")


@query(f"""WITH r AS ({_topk("c.label = q.label + 5")}) SELECT e.vec_id AS query_id, count(r.pos)::BIGINT AS n_hits FROM embeddings e LEFT JOIN r ON r.query_id = e.vec_id GROUP BY e.vec_id""")
def topk_empty_filter(spark, sf):
    plans = _plans(spark, sf, year=F.col("label") + 5)
    hits = retrieval.retrieve(plans, _chunks(spark, sf), K).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return plans.select("query_id").join(hits, "query_id", "left").fillna(0, ["n_hits"])


@query("""SELECT count(*) AS chunk_count, count(DISTINCT label) AS document_count, max(len(embedding))::INT AS embedding_dim, 'parquet_flat_ip' AS index_backend,
  'hash' AS embedding_backend, 7 AS top_k, TRUE AS normalize_embeddings FROM embeddings""")
def index_manifest(spark, sf):
    index = t(spark, sf, "embeddings").select(F.struct(F.col("label").cast("string").alias("source_path")).alias("metadata"), F.col("embedding").alias("vector"))
    config = {"vector_db_type": "parquet", "chunk_size": SIZE, "chunk_overlap": OVERLAP, "top_k": 7, "selected_years": YEARS, "document_years": YEARS, "data_dir": "d", "embedding": {"normalize": True}}
    row = pipelines.manifest(index, config, providers.HashEmbedder(64))
    return row.select("chunk_count", "document_count", "embedding_dim", "index_backend", "embedding_backend", "top_k", "normalize_embeddings")


# ---------------------------------------------------------------- answers against texts


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
WHERE CASE WHEN a.o_totalprice = 0 THEN abs(b.o_totalprice) <= 0.001 ELSE abs(b.o_totalprice - a.o_totalprice) / abs(a.o_totalprice) <= 0.001 END""")
def numbers_close_join(spark, sf):
    o = t(spark, sf, "orders")
    a = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("x"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("y"))
    return a.join(b, "o_custkey").filter((F.col("a") != F.col("b")) & matching.close(F.col("y"), F.col("x"), matching.TEXT_TOLERANCE)).select("a", "b")


@query("SELECT o_orderkey, o_orderstatus <> 'P' AS same FROM orders")
def answer_match(spark, sf):
    factor = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 1.005).otherwise(1.05)
    gold = F.concat(F.lit("It came to $"), F.format_number("o_totalprice", 2), F.lit("."))
    said = F.concat(F.lit("about "), F.format_number(F.col("o_totalprice") * factor, 2), F.lit(" in all"))
    return t(spark, sf, "orders").select("o_orderkey", matching.answer_matches(said, gold).alias("same"))


@query(f"""WITH d AS (SELECT doc_id, {_norm('text')} AS n FROM documents), b AS (SELECT item_id, {_norm('text')} AS n FROM benchmark)
SELECT item_id, doc_id FROM d JOIN b ON b.n <> '' AND contains(d.n, b.n)""")
def answer_contains_join(spark, sf):
    answers = t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), text.normalize_answer(F.col("text")).alias("an"), text.numbers(F.col("text")).alias("ann"))
    held = containment.holders(answers, evaluation.prepare_chunks(_doc_chunks(spark, sf)))
    return held.select(F.col("question_id").alias("item_id"), F.col("chunk_id").alias("doc_id"))


def _doc_chunks(spark, sf):
    d = wide(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "text", (F.lit(2000) + F.col("doc_id") % 5).cast("int").alias("year"), (F.col("doc_id") % 12 + 1).cast("int").alias("month"), F.col("doc_id").alias("pos"))


def _gold(spark, sf):
    pair = F.struct((F.lit(2000) + F.col("item_id") % 5).cast("int").alias("year"), (F.col("item_id") % 12 + 1).cast("int").alias("month"))
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("gold_answer"), F.array(pair).alias("pairs"))


@query(f"""WITH d AS (SELECT doc_id, {_norm('text')} AS n FROM documents), b AS (SELECT item_id, {_norm('text')} AS n FROM benchmark),
c AS (SELECT item_id AS question_id, doc_id AS chunk_id, b.n <> '' AND contains(d.n, b.n) AS hit FROM b JOIN d ON doc_id % 5 = item_id % 5 AND doc_id % 12 = item_id % 12)
SELECT question_id, chunk_id FROM c QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY question_id)""")
def relevance_fallback_sets(spark, sf):
    chunks = evaluation.prepare_chunks(_doc_chunks(spark, sf))
    return evaluation.every_relevant_chunk(evaluation.relevant_chunks(_gold(spark, sf), chunks), chunks)


def _near(c: str, t: str) -> str:
    return f"CASE WHEN {t} = 0 THEN abs({c}) <= 0.001 ELSE abs({c} - {t}) / abs({t}) <= 0.001 END"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey::DOUBLE AS k, o_totalprice / 100 AS p, o_orderkey % 7 = 0 AS two, o_orderkey % 5 = 0 AS dated, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders),
c AS (SELECT c_custkey, c_custkey::DOUBLE AS k, c_acctbal AS b, 1992 + c_custkey % 7 AS y, c_custkey % 12 + 1 AS m FROM customer)
SELECT o_orderkey, c_custkey FROM o JOIN c ON (NOT dated OR (o.y = c.y AND o.m = c.m)) WHERE ({_near("c.b", "o.p")} OR {_near("c.k", "o.p")}) AND (NOT two OR {_near("c.b", "o.k")} OR {_near("c.k", "o.k")})""")
def answer_numbers_join(spark, sf):
    """Answers by their numbers, through the index of rarest ranges: a hundredth of an order's price near a customer's
    balance; every seventh also names the customer, every fifth is sought in its month only."""
    dated, two = F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 7 == 0
    price = F.col("o_totalprice") / 100
    when = lambda c: F.when(dated, c("o_orderdate"))
    answers = spread(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).select(F.col("o_orderkey").alias("question_id"), F.lit("").alias("an"), F.when(two, F.array(price, F.col("o_custkey").cast("double"))).otherwise(F.array(price)).alias("ann"), when(F.year).alias("year"), when(F.month).alias("month"))
    key = F.col("c_custkey")
    texts = t(spark, sf, "customer").select(key.alias("chunk_id"), (F.lit(1992) + key % 7).cast("int").alias("year"), (key % 12 + 1).cast("int").alias("month"), F.lit("").alias("norm_text"), F.array(F.col("c_acctbal"), key.cast("double")).alias("text_numbers"))
    return containment.by_index(answers, texts).select(F.col("question_id").alias("o_orderkey"), F.col("chunk_id").alias("c_custkey"))


@query(f"""WITH d AS (SELECT doc_id, {_norm('text')} AS n FROM documents), b AS (SELECT item_id, {_norm('text')} AS n FROM benchmark),
w AS (SELECT item_id * 4 + unnest([0, 1, 2, 3]) AS answer_id, unnest([n, left(n, 9), right(n, 23), substr(n, 7, 40)]) AS n FROM b)
SELECT answer_id, doc_id FROM d JOIN w ON w.n <> '' AND contains(d.n, w.n)""")
def answer_windows_join(spark, sf):
    """Answers and parts of them, cut without regard to words, through the index of their rarest windows."""
    an = text.normalize_answer(F.col("text"))
    parts = t(spark, sf, "benchmark").select("item_id", F.posexplode(F.array(an, F.substring(an, 1, 9), F.right(an, F.lit(23)), F.substring(an, 7, 40))).alias("k", "an"))
    answers = parts.select((F.col("item_id") * 4 + F.col("k")).alias("question_id"), "an", F.array().cast("array<double>").alias("ann"), *[F.lit(None).cast("int").alias(c) for c in ("year", "month")])
    held = containment.by_index(answers, evaluation.prepare_chunks(_doc_chunks(spark, sf)))
    return held.select(F.col("question_id").alias("answer_id"), F.col("chunk_id").alias("doc_id"))


# ---------------------------------------------------------------- joins of results


@query("""WITH l AS (SELECT vec_id AS question_id, unnest([vec_id + 3, -1, vec_id + 1, vec_id + 2]) AS chunk_id, unnest([0, 1, 2, 3]) AS place FROM embeddings)
SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY place)::INT AS rank FROM l WHERE chunk_id IN (SELECT vec_id FROM embeddings)""")
def retrieved_lookup_join(spark, sf):
    e = t(spark, sf, "embeddings")
    v = F.col("vec_id")
    p = e.select(v.alias("question_id"), F.to_json(F.array(*[x.cast("string") for x in (v + 3, F.lit(-1), v + 1, v + 2)])).alias("retrieved_context_ids"))
    each = p.select("question_id", F.posexplode(evaluation.retrieved_ids(p)).alias("at", "id")).select("question_id", "at", F.col("id").cast("long").alias("chunk_id"))
    known = each.join(e.select(v.alias("chunk_id")), "chunk_id")
    return known.select("question_id", "chunk_id", F.row_number().over(Window.partitionBy("question_id").orderBy("at")).alias("rank"))


@query("""SELECT e.event_id AS question_id, e.event_type, l.event_id AS last_event FROM events e
LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id) l ON l.user_id = e.event_id""")
def log_merge_left_join(spark, sf):
    e = t(spark, sf, "events")
    logs = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("question_id")).agg(F.max("event_id").alias("last_event"), F.max("event_type").alias("event_type"))
    return evaluation.with_logs(e.select(F.col("event_id").alias("question_id"), "event_type"), logs).select("question_id", "event_type", "last_event")


@query("""WITH k AS (SELECT item_id AS r, CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR END AS uid, text AS question FROM benchmark),
p AS (SELECT item_id, (item_id + 1)::VARCHAR AS question_id, CASE WHEN item_id % 3 = 0 THEN item_id // 3 END AS row_id, text AS question FROM benchmark),
f AS (SELECT question, min(r) AS r FROM k GROUP BY question)
SELECT p.item_id, coalesce(a.r, b.r, f.r) AS answer_row FROM p LEFT JOIN k a ON a.uid = p.question_id LEFT JOIN k b ON b.r = p.row_id LEFT JOIN f ON f.question = p.question""")
def answer_key_fallback(spark, sf):
    b, i = t(spark, sf, "benchmark"), F.col("item_id")
    key = b.select(i.alias("_row"), F.when(i % 2 == 0, i.cast("string")).alias("uid"), F.col("text").alias("question"), i.alias("answer_row"))
    p = b.select("item_id", (i + 1).cast("string").alias("question_id"), F.when(i % 3 == 0, F.floor(i / 3)).alias("row_id"), F.col("text").alias("question"))
    return evaluation.with_answers(p, key).select("item_id", F.col("key_answer_row").alias("answer_row"))


# ---------------------------------------------------------------- metrics


@query(f"""WITH h AS ({_topk("TRUE")}), l AS (SELECT vec_id, label FROM embeddings), n AS (SELECT label, count(*) AS n FROM l GROUP BY label),
j AS (SELECT h.query_id, h.rank, q.label = c.label AS good FROM h JOIN l q ON q.vec_id = h.query_id JOIN l c ON c.vec_id = h.pos),
g AS (SELECT query_id, bool_or(good) AS hit, min(CASE WHEN good THEN rank END) AS first, count(*) FILTER (good) AS found FROM j GROUP BY query_id)
SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, round(sum(found)::DOUBLE / sum(n), 6) AS recall,
  count(*) FILTER (hit) AS docs_found
FROM g JOIN l ON l.vec_id = g.query_id JOIN n ON n.label = l.label""")
def hit_mrr_recall(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = retrieval.retrieve(_plans(spark, sf), _chunks(spark, sf), K)
    got = answering.collect_hits(hits, ["pos"], "query_id").select(F.col("query_id").alias("question_id"), F.transform("hits", lambda h: h["pos"]).alias("ids"))
    one = F.array(F.struct(F.col("label").alias("year"), F.lit(1).alias("month")))
    # Gold answers that no chunk holds: then all chunks of a question's dates are relevant.
    gold = e.select(F.col("vec_id").alias("question_id"), one.alias("pairs"), F.lit("nowhere").alias("gold_answer"))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("year"), F.lit(1).alias("month"), F.col("vec_id").alias("pos"), F.lit("x").alias("text"))
    relevant = evaluation.relevant_chunks(gold, evaluation.prepare_chunks(chunks))
    s = evaluation.retrieval_scores(got, chunks, relevant, gold)
    m = s.agg(F.avg("hit").alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr"), evaluation.ratio(F.sum("relevant_found"), F.sum("total_relevant"), 0.0).alias("recall"), F.sum("correct_docs_found").alias("docs_found"))
    return m.select(*[F.round(c, 6).alias(c) if c != "docs_found" else F.col(c) for c in m.columns])


@query("""SELECT round(sum(quality)::DOUBLE / count(*), 9) AS groundedness, round(sum(quality)::DOUBLE / count(*), 9) AS factual_accuracy, round(sum(toxic)::DOUBLE / count(*), 9) AS hallucination_rate,
  round(sum(toxic)::DOUBLE / sum(quality + 1), 9) AS recall FROM labels""")
def claim_ratios(spark, sf):
    one = F.lit(1)
    d = t(spark, sf, "labels").select(F.lit(0.0).alias("hit"), F.lit(0.0).alias("reciprocal_rank"), F.col("toxic").alias("relevant_found"), (F.col("quality") + 1).alias("total_relevant"), F.col("quality").alias("supported_claims"), one.alias("total_claims"), F.col("toxic").alias("fabricated_claims"), F.col("quality").alias("correct_answer"))
    return evaluation.metrics(d).select(*[F.round(c, 9).alias(c) for c in ("groundedness", "factual_accuracy", "hallucination_rate", "recall")])


@query("""SELECT doc_id, quality::INT AS supported_claims, (CASE doc_id % 6 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE quality + toxic END)::INT AS total_claims,
  (CASE doc_id % 6 WHEN 4 THEN 0 ELSE toxic END)::INT AS fabricated_claims, (CASE doc_id % 6 WHEN 3 THEN 0 ELSE quality END)::INT AS correct_answer FROM labels WHERE doc_id % 6 <> 5 AND doc_id % 7 <> 3""")
def judge_coercion(spark, sf):
    """Replies of many shapes, read by expressions alone; one in six can't be read and gives nothing. All give back a request
    that looks like a verdict; one in seven says nothing else, and every third lies deep in lists and objects."""
    q, x, n = F.col("quality").cast("string"), F.col("toxic").cast("string"), (F.col("quality") + F.col("toxic")).cast("string")
    yes = F.when(F.col("quality") == 1, "Yes").otherwise("incorrect")
    shape = lambda s, t, f, c: F.concat(F.lit('{"supported_claims": '), *s, F.lit(', "total_claims": '), *t, F.lit(', "fabricated_claims": '), *f, F.lit(', "correct_answer": '), *c, F.lit("}"))
    lit = F.lit
    said = [
        shape([lit('"'), q, lit('"')], [lit('{"count": ['), n, lit("]}")], [x, lit(".0")], [lit('["'), yes, lit('"]')]),
        F.concat(lit("Here it is: "), shape([lit("["), q, lit("]")], [lit('{"total": {"value": "'), n, lit('"}}')], [lit('{"count": '), x, lit("}")], [lit('{"is_correct": '), q, lit("}")]), lit("\nDone.")),
        shape([q], [lit('{"claims": ["a", "b", "c"]}')], [F.when(F.col("toxic") == 1, "true").otherwise("false")], [q, lit(".4")]),
        shape([q, lit(".9")], [lit("null")], [lit('" '), x, lit('"')], [lit("null")]),
        shape([lit("["), F.when(F.col("quality") == 1, '{"a": 1}').otherwise(""), lit("]")], [n], [lit("-3")], [lit('{"correct": {"value": '), q, lit("}}")]),
        shape([lit('"several"')], [n], [x], [q]),
    ]
    reply = said[5]
    for k in range(5):
        reply = F.when(F.col("doc_id") % 6 == k, said[k]).otherwise(reply)
    reply = F.when(F.col("doc_id") % 7 == 3, "I cannot say").otherwise(reply)
    request = F.to_json(F.struct(*[F.lit(1).alias(c) for c in ("supported_claims", "total_claims", "fabricated_claims", "correct_answer")]))
    asked = F.struct(F.struct(F.struct(request.alias("prompt")).alias("body")).alias("request"), F.array(F.struct(F.struct(reply.alias("content")).alias("message"))).alias("choices"))
    deep = F.struct(F.array(F.struct(request.alias("asked")), F.struct(request.alias("asked"))).alias("log"), F.struct(F.array(F.array(F.struct(F.array(F.struct(reply.alias("text"))).alias("content")))).alias("parts")).alias("result"))
    part = F.when(F.col("doc_id") % 3 == 1, F.to_json(deep)).otherwise(F.to_json(asked))
    told = t(spark, sf, "labels").select("doc_id", judging.verdict(judging.reply_text(part)).alias("v"))
    return told.filter("v IS NOT NULL").select("doc_id", "v.*")


# ---------------------------------------------------------------- answers


def _turns(spark, sf):
    c = t(spark, sf, "conversations")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", "role", "text", rank.alias("rank"), F.lit("c.txt").alias("source_path"), F.lit(2024).alias("year"), F.col("turn").cast("int").alias("month"), F.col("turn").alias("chunk_id"))


_TURNS = f"""c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS rank, {_collapse('text')} AS clean FROM conversations),
u AS (SELECT *, coalesce(sum(length(clean)) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c),
s AS (SELECT conv_id, rank, 'S' || rank AS label, substr(clean, 1, ({BUDGET} - used)::INT) AS text, 'c.txt | 2024-' || lpad(turn::VARCHAR, 2, '0') || ' | ' || turn AS citation FROM u WHERE clean <> '' AND used < {BUDGET})"""


@query(f"WITH {_TURNS} SELECT conv_id, rank, label, md5(text) AS digest, citation FROM s")
def context_budget(spark, sf):
    s = answering.snippets(_turns(spark, sf), BUDGET, answering.BASE_FIELDS, "conv_id")
    return s.select("conv_id", "rank", "label", F.md5("text").alias("digest"), "citation")


@query(f"""WITH {_TURNS}, b AS (SELECT conv_id, string_agg('[' || label || '] ' || citation || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM s GROUP BY conv_id)
SELECT conv_id, 2 AS n_messages, md5('# Excerpts' || chr(10) || chr(10) || context || chr(10) || chr(10) || '# Question' || chr(10) || chr(10) || 'Conversation ' || conv_id || '?') AS digest FROM b""")
def prompt_messages(spark, sf):
    b = answering.context_blocks(answering.snippets(_turns(spark, sf), BUDGET, answering.BASE_FIELDS, "conv_id"), "conv_id")
    m = b.select("conv_id", answering.messages(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit("?")), F.col("context")).alias("m"))
    return m.select("conv_id", F.size("m").alias("n_messages"), F.md5(F.col("m")[1]["content"]).alias("digest"))


@query(f"""WITH q AS (SELECT conv_id, {_terms("text", 2)} AS q FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, {_sentences('text')} AS s FROM conversations),
x AS (SELECT conv_id, rank, unnest(s) AS s, unnest(range(len(s))) AS i FROM h),
o AS (SELECT x.*, len(list_intersect(q.q, {_terms("s")})) AS o FROM x JOIN q USING (conv_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o DESC, rank, length(s), i) AS p FROM o)
SELECT conv_id, md5(string_agg(s || ' [S' || rank || ']', ' ' ORDER BY p)) AS digest FROM r WHERE p <= 2 GROUP BY conv_id""")
def extractive_answer(spark, sf):
    turns = _turns(spark, sf)
    asked = turns.filter("rank = 1").select("conv_id", F.col("text").alias("question"))
    held = answering.collect_hits(turns, ["text"], "conv_id").join(asked, "conv_id")
    return held.select("conv_id", F.md5(answering.extractive(F.col("hits"), F.col("question"))).alias("digest"))


@query(f"""SELECT conv_id, turn, md5(CASE WHEN {_collapse('text')} = '' THEN 'NOT_FOUND' WHEN turn % 3 = 0 THEN 'NOT_FOUND' WHEN turn % 3 = 1 THEN {_collapse("text || ' [S1]'")}
  WHEN regexp_matches(text, '\\[S\\d+\\]') THEN {_collapse('text')} ELSE 'see source [S2]' END) AS digest FROM conversations""")
def citation_guard(spark, sf):
    said = F.when(F.col("turn") % 3 == 0, F.lit(" not_found: nothing")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" [S1]"))).otherwise(F.col("text"))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.md5(answering.guard(said, F.lit("see source [S2]"))).alias("digest"))


# ---------------------------------------------------------------- more of the runs


@query("SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN event_type ELSE '' END AS said FROM events")
def prediction_coalesce(spark, sf):
    first = F.when(F.col("event_type") == "click", F.col("props"))
    p = t(spark, sf, "events").select("event_id", first.alias("predicted_answer"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("prediction"))
    return p.select("event_id", evaluation.prediction_text(p).alias("said"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 2030 ELSE year(o_orderdate) END::INT AS year,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE month(o_orderdate) END::INT AS month, o_orderstatus = 'P' AS own FROM orders""")
def relevant_pairs(spark, sf):
    """The key's source columns name the dates; where they don't, the prediction's own date stands in."""
    source = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("b_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit(".txt")))
    p = t(spark, sf, "orders").select("o_orderkey", source.alias("key_source_files"), F.lit("2030").alias("detected_year"), F.lit("1.0").alias("detected_month"), (F.col("o_orderstatus") == "P").alias("own"))
    pairs = p.select("o_orderkey", evaluation.relevant_pairs(p).alias("p"), "own")
    return pairs.select("o_orderkey", F.col("p")[0]["year"].alias("year"), F.col("p")[0]["month"].alias("month"), "own")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS n FROM orders")
def source_pairs(spark, sf):
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    pair = lambda y, m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"))
    named = F.when(F.col("o_orderstatus") == "F", F.array(pair(year, month), pair(year + 1, month), pair(year, month))).otherwise(F.array().cast(dates.PAIRS))
    own = F.when(F.col("o_orderstatus") == "O", month)
    return t(spark, sf, "orders").select("o_orderkey", F.size(dates.source_date_pairs(named, year, own)).alias("n"))


_TASK = evaluation.JUDGE_TASK.replace("'", "''")


@query(f"""SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), '{_TASK}', '# Question', 'q' || turn, '# Expected', 'g', '# Given', role, '# Passages', '(1) ' || substr({_collapse('text')}, 1, 4000), '(2) again')) AS digest FROM conversations""")
def judge_prompts(spark, sf):
    prompt = evaluation.judge_prompt(F.concat(F.lit("q"), F.col("turn")), F.col("role"), F.array(F.col("text"), F.lit("again")), F.lit("g"))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.md5(prompt).alias("digest"))


@query(f"SELECT doc_id, len({_tokens('text')})::INT AS n_tokens, len(list_distinct({_terms('text', 2)}))::INT AS n_terms FROM documents")
def token_and_term_counts(spark, sf):
    d = wide(spark, sf, "documents")
    return d.select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.size(text.terms(F.col("text"), 2)).alias("n_terms"))
