"""Queries that go through files and providers: what a run writes is read back and held against SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import dates
from ..operators import answering, evaluation, retrieval
from ..sources import npy, readers, sinks
from ..sources.scratch import scratch
from ..streaming import ingest
from . import config as settings
from . import pipelines
from .catalogue import _PACK, SIZE, _collapse, _norm, _sentences, _terms, t
from .registry import query

#: Word stems that the offline embedder looks for, and what the runs are asked for.
WORDS = ["thou", "heron", "ndea", "onst", "edst", "lyat", "ouor", "blees", "rened", "tionsh"]
DOCUMENT_YEARS, SELECTED_YEARS = [2001, 2002, 2003], [2001, 2003]

# ---------------------------------------------------------------- files

_FILES = """m AS (SELECT doc_id, (2000 + doc_id % 5)::INT AS year, (doc_id % 12 + 1)::INT AS month, text FROM documents),
g AS (SELECT year, month, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM m WHERE year IN (2001, 2002, 2003) GROUP BY year, month),
src AS (SELECT (row_number() OVER (ORDER BY year, month) - 1)::BIGINT AS doc_id, year, month, text FROM g)"""


def _write_documents(spark, sf, root: str, years: list[int] | None = None, folder: str = "docs") -> str:
    """Text files, one for each of sixty months or of the years' months, in folders that are named after them."""
    year, month = F.lit(2000) + F.col("doc_id") % 5, F.col("doc_id") % 12 + 1
    rows = t(spark, sf, "documents").select("doc_id", "text", F.format_string("%d_%02d", year, month).alias("name"))
    if years:
        rows = rows.filter(year.isin(years))
    rows.repartition("name").sortWithinPartitions("name", "doc_id").select("text", "name").write.mode("append").partitionBy("name").text(f"{root}/{folder}")
    return f"{root}/{folder}"


@query(f"WITH {_FILES} SELECT doc_id AS doc_pos, year, month, md5(text) AS digest FROM src WHERE TRUE")
def documents_scan(spark, sf):
    docs = readers.documents(spark, _write_documents(spark, sf, scratch(spark, "documents")), DOCUMENT_YEARS)
    return docs.select("doc_pos", "year", "month", F.md5("text").alias("digest"))


def _write_key(spark, sf, root: str) -> str:
    i = F.col("item_id")
    year, month = F.lit(2000) + i % 5, i % 12 + 1
    asked = F.concat("text", F.format_string(" (%02d/%d)", month, year))
    rows = t(spark, sf, "benchmark").orderBy("item_id").coalesce(1)
    sinks.write_csv(rows.select(i.alias("uid"), asked.alias(" Query "), F.col("text").alias("Ground_Truth"), F.format_string("%d_%02d.txt", year, month).alias("source_files")), f"{root}/key.csv")
    return f"{root}/key.csv"


@query("""SELECT item_id::VARCHAR AS question_id, md5(text || ' (' || lpad((item_id % 12 + 1)::VARCHAR, 2, '0') || '/' || (2000 + item_id % 5) || ')') AS question, md5(text) AS gold,
  (2000 + item_id % 5)::INT AS row_year, (item_id % 12 + 1)::INT AS row_month, 1 AS n_pairs, row_number() OVER (ORDER BY item_id) - 1 AS row
FROM benchmark QUALIFY (2000 + item_id % 5) IN (2001, 2003)""")
def answer_key_scan(spark, sf):
    key = readers.answer_key(spark, _write_key(spark, sf, scratch(spark, "key")))
    q = readers.questions_of_years(key, SELECTED_YEARS)
    return q.select("question_id", F.md5("question").alias("question"), F.md5("gold_answer").alias("gold"), "row_year", "row_month", F.size("source_date_pairs").alias("n_pairs"), F.col("_row").alias("row"))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey::VARCHAR AS question_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 1990 WHEN o_orderkey % 3 = 1 THEN 1971 ELSE year(o_orderdate) END::INT AS row_year, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 12 + 1 WHEN o_orderkey % 3 = 2 THEN month(o_orderdate) END::INT AS row_month,
  CASE WHEN o_orderkey % 3 = 2 OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) THEN 1 ELSE 0 END AS n_pairs FROM orders""")
def key_dates(spark, sf):
    """Years and months of an answer key: columns of its own go first, a month without a year is left out, then the sources'
    dates count, then a bare year in the question."""
    path, o = f"{scratch(spark, 'dates')}/key.csv", F.col("o_orderkey")
    rows = t(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    own, named = o % 3 == 0, o % 3 == 2
    sinks.write_csv(
        rows.select(
            o.alias("ID"), F.when(o % 3 == 1, "What was it in 1971?").otherwise("What was it?").alias("question"), F.lit("x").alias("answer"), F.when(own, 1990).alias(" Year "),
            F.when(own & (o % 2 == 0) | (o % 3 == 1), o % 12 + 1).alias("month"), F.when(named, F.date_format("o_orderdate", "yyyy_MM")).alias("source_file"),
        ),
        path,
    )
    q = readers.questions(readers.answer_key(spark, path))
    return q.select(F.col("_row").alias("row"), "question_id", "row_year", "row_month", F.size("source_date_pairs").alias("n_pairs"))


_CHUNKS = f"""{_FILES}, {_PACK.replace("FROM documents", "FROM src")},
allw AS (SELECT doc_id, flatten(list(words ORDER BY i)) AS w, list(heading ORDER BY i) AS hs FROM blocks GROUP BY doc_id),
chunk AS (
  SELECT doc_id * 10000000 + chunk_no AS pos, year, month, printf('%d_%02d_%05d', year, month, chunk_no) AS chunk_id, hs[c.b + 1] AS heading,
    CASE WHEN c.t THEN 'table' ELSE 'text' END AS content_type, array_to_string(w[c.s + 1 : c.e], ' ') AS text
  FROM ch JOIN allw USING (doc_id) JOIN src USING (doc_id)
)"""


def _config(root: str, **more) -> dict:
    raw = {
        "data_dir": f"{root}/docs", "csv_path": f"{root}/key.csv", "selected_years": SELECTED_YEARS, "document_years": DOCUMENT_YEARS, "vector_db_type": "parquet",
        "chunk_size": SIZE, "chunk_overlap": 50, "top_k": 5, "index_dir": f"{root}/index", "embedding": {"backend": "keyword", "words": WORDS},
        "runs": {m: {"output_dir": f"{root}/{m}"} for m in settings.RUN_MODES},
    }
    return settings.run(raw | more, "question_filter")


@query(f"WITH RECURSIVE {_CHUNKS} SELECT chunk_id, year, month, heading, content_type, md5(text) AS digest, 1 AS files_agree FROM chunk")
def chunk_file(spark, sf):
    """Chunks as an index run leaves them, by way of the chunk file; the index has to agree with it."""
    root = scratch(spark, "chunks")
    _write_documents(spark, sf, root)
    c = _config(root)
    pipelines.build_index(spark, c)
    agree = pipelines.check_index(spark, c["index_dir"]).columns and int(pipelines.index_matches(spark, c) and not pipelines.index_matches(spark, c | {"chunk_size": 9}))
    m = F.col("metadata")
    rows = readers.chunks(spark, f"{c['index_dir']}/chunks.jsonl")
    return rows.select(m["chunk_id"].alias("chunk_id"), m["year"].alias("year"), m["month"].alias("month"), m["heading"].alias("heading"), m["content_type"].alias("content_type"), F.md5("text").alias("digest"), F.lit(agree).alias("files_agree"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT pos, chunk_id, heading, md5(text) AS digest, (SELECT count(*) FROM chunk) AS chunk_count, (SELECT count(DISTINCT (year, month)) FROM chunk) AS document_count FROM chunk")
def streamed_index(spark, sf):
    """Documents that arrive by half years, streamed into an index: the rows and the manifest of a batch run's."""
    root = scratch(spark, "streamed")
    c = _config(root)
    ready = _write_documents(spark, sf, root, DOCUMENT_YEARS, "ready")  # the table is read once, not for each half year
    for year in DOCUMENT_YEARS:
        for late in (False, True):
            for month in range(7, 13) if late else range(1, 7):
                sinks.move(spark, f"{ready}/name={year}_{month:02d}", c["data_dir"])
            ingest.run(spark, c, f"{root}/checkpoint").awaitTermination()
    said, m = pipelines.read_manifest(spark, c["index_dir"]), F.col("metadata")
    index = pipelines.check_index(spark, c["index_dir"])
    return index.select("pos", m["chunk_id"].alias("chunk_id"), m["heading"].alias("heading"), F.md5("text").alias("digest"), *[F.lit(said[k]).cast("long").alias(k) for k in ("chunk_count", "document_count")])


@query("""SELECT label AS year, (vec_id % 12 + 1)::INT AS month, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first, max(len(embedding))::INT AS dim, TRUE AS refused FROM embeddings GROUP BY ALL""")
def index_append(spark, sf):
    """An index written in two parts; a third one of shorter vectors is refused and leaves nothing."""
    path = f"{scratch(spark, 'append')}/index"
    meta = F.struct(F.col("label").alias("year"), (F.col("vec_id") % 12 + 1).cast("int").alias("month"))
    rows = t(spark, sf, "embeddings").select("vec_id", meta.alias("metadata"), F.col("embedding").alias("vector"))
    sinks.write_index(rows.filter("vec_id % 2 = 0"), path)
    sinks.write_index(rows.filter("vec_id % 2 = 1"), path, "append")
    try:
        sinks.write_index(rows.withColumn("vector", F.slice("vector", 1, 3)), path, "append")
        refused = False
    except Exception as e:  # noqa: BLE001  the error comes out of the write as Spark wraps it
        refused = "components" in str(e)
    back = readers.vectors(spark, path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vector")[0].cast("double")), 4).alias("first"), F.max(F.size("vector")).alias("dim")).withColumn("refused", F.lit(refused))


@query("""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, round(embedding[1]::DOUBLE, 5) AS first, len(embedding)::INT AS dim FROM embeddings""")
def npy_files(spark, sf):
    """Vectors written as NumPy matrices and read again by ranges of bytes, in the order of files and rows."""
    path = f"{scratch(spark, 'npy')}/vectors.npy"
    e = t(spark, sf, "embeddings").repartitionByRange(5, "vec_id").sortWithinPartitions("vec_id")
    # The number goes along in the vector: halves of it, as single precision holds 24 bits.
    halves = F.array((F.col("vec_id") % 4096).cast("float"), F.floor(F.col("vec_id") / 4096).cast("float"))
    npy.write(e.select(F.concat(F.col("embedding").cast("array<float>"), halves).alias("vector")), path)
    back = readers.vectors(spark, path)
    number = (F.element_at("vector", -1) * 4096 + F.element_at("vector", -2)).cast("long")
    return back.select("pos", number.alias("vec_id"), F.round(F.col("vector")[0], 5).alias("first"), (F.size("vector") - 2).alias("dim"))


@query("""SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row, conv_id::VARCHAR AS question_id, md5(' ' || text || '"') AS question, CASE WHEN turn % 2 = 0 THEN role END AS gold_answer, md5(text) AS predicted
FROM conversations""")
def prediction_file(spark, sf):
    path = f"{scratch(spark, 'predictions')}/predictions.csv"
    null = F.lit(None).cast("string")
    c = t(spark, sf, "conversations").orderBy("conv_id", "turn")  # in as many files as their size asks for
    rows = c.select(F.col("conv_id").alias("question_id"), F.concat(F.lit(" "), "text", F.lit('"')).alias("question"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("gold_answer"), F.col("text").alias("predicted_answer"), null.alias("detected_year"), null.alias("detected_month"), F.lit("x").alias("retrieval_method"))
    sinks.write_predictions(rows, path)
    back = readers.predictions(spark, path)
    return back.select(F.col("_row").alias("row"), "question_id", F.md5("question").alias("question"), "gold_answer", F.md5(evaluation.prediction_text(back)).alias("predicted"))


@query("""SELECT user_id::VARCHAR AS question_id, max(event_id)::INT AS detected_year, arg_max(event_type, event_id) AS said FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def log_file(spark, sf):
    """Of several log lines of a question the last one counts, in the order of seven files of other sizes; lines without a
    question don't; no file, no logs."""
    root = scratch(spark, "logs")
    e = t(spark, sf, "events").repartitionByRange(7, "event_id").sortWithinPartitions("event_id")
    sources = F.array(F.struct(F.col("event_type").alias("chunk_id")))
    sinks.write_json(e.select(F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("question_id"), F.col("event_id").alias("detected_year"), sources.alias("final_sources")), f"{root}/logs.jsonl")
    logs = readers.retrieval_logs(spark, f"{root}/logs.jsonl").unionByName(readers.retrieval_logs(spark, f"{root}/none.jsonl"))
    return logs.select("question_id", "detected_year", F.get(evaluation.retrieved_ids(logs.select("question_id", "detected_year", "final_sources")), F.lit(0)).alias("said"))


# ---------------------------------------------------------------- runs

_WORDS = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_FLAGS = f"list_transform({_WORDS}, lambda w: contains(lower(text), w)::INT::DOUBLE)"
_UNIT = "list_transform(f, lambda x: x / greatest(sqrt(list_sum(list_transform(f, lambda y: y * y))), 1e-12))"
_ANSWERS = f"""{_CHUNKS},
cf AS (SELECT *, {_FLAGS} AS f FROM chunk), cv AS (SELECT *, {_UNIT} AS v FROM cf),
q AS (SELECT item_id, (2000 + item_id % 5)::INT AS year, (item_id % 12 + 1)::INT AS month, text || ' (' || lpad((item_id % 12 + 1)::VARCHAR, 2, '0') || '/' || (2000 + item_id % 5) || ')' AS text FROM benchmark),
qf AS (SELECT *, {_FLAGS} AS f FROM q WHERE year IN (2001, 2003)), qv AS (SELECT *, {_UNIT} AS v FROM qf),
h AS (
  SELECT qv.item_id, qv.text AS question, cv.chunk_id, cv.text, round(list_inner_product(qv.v, cv.v), 6) AS score,
    row_number() OVER (PARTITION BY qv.item_id ORDER BY round(list_inner_product(qv.v, cv.v), 6) DESC, cv.pos) AS rank
  FROM qv JOIN cv ON qv.year = cv.year AND qv.month = cv.month QUALIFY rank <= 5
),
hs AS (SELECT item_id, rank, question, {_sentences('text')} AS s FROM h),
x AS (SELECT item_id, rank, question, unnest(s) AS s, unnest(range(len(s))) AS i FROM hs),
o AS (SELECT *, len(list_intersect({_terms('question', 2)}, {_terms('s')})) AS o FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, rank, length(s), i) AS p FROM o),
a AS (SELECT item_id, string_agg(s || ' [S' || rank || ']', ' ' ORDER BY p) AS answer FROM r WHERE p <= 2 GROUP BY item_id)"""


@query(f"""WITH RECURSIVE {_ANSWERS}
SELECT h.item_id::VARCHAR AS question_id, string_agg(h.chunk_id, ',' ORDER BY h.rank) AS ids, round(sum(h.score), 4) AS score, md5({_collapse('any_value(a.answer)')}) AS answer, any_value(qv.year) AS detected_year,
  any_value(qv.month) AS detected_month, 0 AS asked_again, md5(string_agg(h.chunk_id || chr(9) || h.text, chr(10) ORDER BY h.rank)) AS context, 'metadata_rag/exact_vector_top_k/5/extractive' AS run FROM h JOIN a USING (item_id) JOIN qv USING (item_id) GROUP BY h.item_id""")
def run_answers(spark, sf):
    """The whole way offline: files to chunks, vectors, an index; questions to filters, retrieved chunks, answers, logs.

    A second run that resumes the first has no question left to ask.
    """
    root = scratch(spark, "run")
    _write_documents(spark, sf, root)
    _write_key(spark, sf, root)
    c = _config(root)
    first = pipelines.run_qa(spark, c).count()
    again = pipelines.run_qa(spark, c, resume=True).count() - first
    logs = readers.retrieval_logs(spark, f"{c['output_dir']}/retrieval_logs.jsonl")
    said = readers.predictions(spark, f"{c['output_dir']}/predictions.csv")
    score = F.aggregate("final_sources", F.lit(0.0), lambda s, x: s + x["vector_score"])
    both = said.select("question_id", "predicted_answer").join(logs, "question_id")
    return both.select(
        "question_id", F.array_join("final_context_ids", ",").alias("ids"), F.round(score, 4).alias("score"), F.md5("predicted_answer").alias("answer"), "detected_year", "detected_month", F.lit(again).alias("asked_again"),
        F.md5(F.array_join(F.transform("final_context", lambda c: F.concat(c["chunk_id"], F.lit("\t"), c["text"])), "\n")).alias("context"),
        F.concat_ws("/", *[F.get_json_object("model_config", f"$.{k}") for k in ("pipeline", "retrieval", "top_k", "generation_model")]).alias("run"),
    )


@query(f"""WITH RECURSIVE {_ANSWERS},
n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row FROM benchmark), k AS (SELECT dense_rank() OVER (ORDER BY row // 20) AS nth, item_id FROM n JOIN qv USING (item_id))
SELECT k.item_id::VARCHAR AS question_id, CASE WHEN nth = 1 THEN 1 ELSE 2 END AS in_run, md5({_collapse('a.answer')}) AS answer, count(*) OVER ()::BIGINT AS predictions FROM k JOIN a USING (item_id)""")
def resumed_answers(spark, sf):
    """Slices of twenty rows of the answer key: a run that stops after one slice, and one that resumes it and asks the rest."""
    root = scratch(spark, "resumed")
    _write_documents(spark, sf, root)
    _write_key(spark, sf, root)
    c = _config(root, generation={"backend": "extractive", "slice_questions": 20})
    seen, runs = None, []
    for most in (1, None):
        now = pipelines.run_qa(spark, c, resume=bool(runs), most_slices=most).select(F.col("question_id"), "question_no", F.md5("predicted_answer").alias("answer"))
        new = now if seen is None else sinks.without_done(now, seen, "question_no")
        path = f"{root}/seen-{len(runs)}"
        new.withColumn("in_run", F.lit(len(runs) + 1)).write.parquet(path)
        runs.append(path)
        seen = spark.read.parquet(*runs)
    said = readers.predictions(spark, f"{c['output_dir']}/predictions.csv").select("question_id").withColumn("predictions", F.count(F.lit(1)).over(Window.partitionBy()))
    return seen.join(said, "question_id").select("question_id", "in_run", "answer", "predictions")


@query(f"""WITH RECURSIVE {_ANSWERS} SELECT item_id, string_agg(chunk_id, ',' ORDER BY rank) AS ids, count(*)::INT AS n FROM h WHERE rank <= 3 GROUP BY item_id""")
def search_index(spark, sf):
    """Filtered search of an index with a count of its own, then with none: nought means the settings' count."""
    root = scratch(spark, "search")
    _write_documents(spark, sf, root)
    c = _config(root)
    pipelines.build_index(spark, c)
    index, i = pipelines.check_index(spark, c["index_dir"]), F.col("item_id")
    asked = F.concat("text", F.format_string(" (%02d/%d)", i % 12 + 1, F.lit(2000) + i % 5))
    q = t(spark, sf, "benchmark").filter((F.lit(2000) + i % 5).isin(SELECTED_YEARS)).select(i.alias("query_id"), asked.alias("question"))
    planned = retrieval.plan(q, "question_filter", SELECTED_YEARS)
    provider = pipelines.embedder(c)
    three, default = pipelines.search(planned, index, c, provider, 3), pipelines.search(planned, index, c, provider, 0)
    both = three.join(default.groupBy("query_id").agg(F.max("rank").alias("most")), "query_id").filter(F.col("most") <= c["top_k"])
    named = both.join(index.select("pos", "metadata.chunk_id"), "pos")
    held = answering.collect_hits(named, ["chunk_id"], "query_id")
    return held.select(F.col("query_id").alias("item_id"), F.array_join(F.transform("hits", lambda h: h["chunk_id"]), ",").alias("ids"), F.size("hits").alias("n"))


@query(f"""WITH d AS (SELECT doc_id::VARCHAR AS id, (2000 + doc_id % 5)::INT AS y, (doc_id % 12 + 1)::INT AS m, {_norm('text')} AS n FROM documents),
p AS (SELECT item_id, CASE WHEN item_id % 5 <> 0 THEN (item_id // 2)::VARCHAR ELSE '' END AS question_id, {_norm('text')} AS gold, item_id % 4 <> 3 AS dated, (2000 + item_id * 7 % 5)::INT AS y, (item_id * 7 % 12 + 1)::INT AS m FROM benchmark),
hit AS (SELECT item_id, id FROM p JOIN d ON d.n <> '' AND contains(d.n, gold) AND (NOT dated OR (d.y = p.y AND d.m = p.m))),
rel AS (SELECT * FROM hit UNION SELECT item_id, id FROM p JOIN d ON (NOT dated OR (d.y = p.y AND d.m = p.m)) WHERE item_id NOT IN (SELECT item_id FROM hit)),
ids AS (SELECT item_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS place, unnest([item_id * 7 + item_id % 3, item_id * 7 + 60, -1, item_id * 7 + 1, item_id * 7 + 120, item_id * 7 + 2, item_id * 7 + 180])::VARCHAR AS id FROM benchmark),
known AS (SELECT ids.*, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rank, d.y, d.m FROM ids JOIN d USING (id) QUALIFY rank <= 5),
j AS (SELECT known.item_id, rank, CASE WHEN p.dated THEN known.y = p.y AND known.m = p.m ELSE (known.item_id, known.id) IN (SELECT (item_id, id) FROM rel) END AS good,
  CASE WHEN p.dated THEN known.y || '-' || known.m ELSE known.id END AS what FROM known JOIN p USING (item_id)),
s AS (SELECT item_id, count(DISTINCT what) FILTER (good) AS docs, min(rank) FILTER (good) AS first FROM j GROUP BY item_id)
SELECT p.question_id, CASE WHEN coalesce(s.docs, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, coalesce(s.docs, 0)::BIGINT AS correct_docs_found, round(coalesce(1.0 / s.first, 0.0)::DOUBLE, 6) AS reciprocal_rank,
  (SELECT count(*) FROM (SELECT DISTINCT id FROM ids WHERE ids.item_id = p.item_id AND place < 5) top JOIN rel ON rel.item_id = p.item_id AND rel.id = top.id)::BIGINT AS relevant_found,
  (SELECT count(*) FROM rel WHERE rel.item_id = p.item_id)::BIGINT AS total_relevant, (p.item_id % 2 = 0)::INT AS exact_answer_match, (p.item_id % 3)::INT AS supported_claims, 3 AS total_claims, (p.item_id % 2)::INT AS fabricated_claims, (p.item_id % 4 <> 0)::INT AS correct_answer,
  round((sum(p.item_id % 3) OVER ())::DOUBLE / (3 * count(*) OVER ()), 6) AS groundedness, (count(*) OVER ())::BIGINT AS judged
FROM p LEFT JOIN s USING (item_id)""")
def evaluate_details(spark, sf):
    """A whole evaluation over files: chunks, predictions that share ids or have none, an answer key, recorded verdicts.
    The details come from the file written, one row for each prediction; so do the metrics and the judge's results."""
    root, i = scratch(spark, "details"), F.col("item_id")
    by_range = lambda name: t(spark, sf, name).repartitionByRange(t(spark, sf, name).columns[0])  # noqa: E731  as many files as their size asks for
    ids = F.to_json(F.array(*[x.cast("string") for x in (i * 7 + i % 3, i * 7 + 60, F.lit(-1), i * 7 + 1, i * 7 + 120, i * 7 + 2, i * 7 + 180)]))
    dated = i % 4 != 3
    rows = by_range("benchmark").select(
        F.when(i % 5 != 0, F.floor(i / 2)).alias("question_id"), F.concat(F.lit("q"), i).alias("question"), F.col("text").alias("gold_answer"),
        F.when(i % 2 == 0, F.concat(F.lit(" "), "text", F.lit("!"))).otherwise("something else").alias("predicted_answer"), F.when(dated, F.lit(2000) + i * 7 % 5).alias("year"), F.when(dated, i * 7 % 12 + 1).alias("month"),
        ids.alias("retrieved_context_ids"),
    )
    sinks.write_csv(rows, f"{root}/out/predictions.csv")
    sinks.write_csv(t(spark, sf, "benchmark").select(i.alias("uid"), F.lit("none of them").alias("question"), F.lit("x").alias("answer")), f"{root}/key.csv")
    d = F.col("doc_id")
    meta = F.struct((F.lit(2000) + d % 5).cast("int").alias("year"), (d % 12 + 1).cast("int").alias("month"), F.lit("p").alias("source_path"), d.cast("string").alias("chunk_id"), F.lit("h").alias("heading"), F.lit("text").alias("content_type"))
    sinks.write_chunks(by_range("documents").select("text", meta.alias("metadata")), f"{root}/index/chunks.jsonl")
    said = F.format_string('Well: {"supported_claims": [%s], "total_claims": "3", "fabricated_claims": {"count": %d}, "correct_answer": {"value": "%s"}}', F.array_join(F.array_repeat(F.lit('"c"'), (i % 3).cast("int")), ","), i % 2, F.when(i % 4 != 0, "yes").otherwise("no"))
    verdicts = t(spark, sf, "benchmark").select(F.concat(F.lit("q"), i).alias("question"), said.alias("verdict"))
    c = {"output_dir": f"{root}/out", "index_dir": f"{root}/index", "csv_path": f"{root}/key.csv", "generation": settings.GENERATION_DEFAULTS}
    found = pipelines.run_evaluation(spark, c, providers.RecordedJudge(verdicts))
    here = pipelines.evaluation_folder(spark, c["output_dir"])
    judged = readers.json_lines(spark, f"{here}/judge_results.jsonl", "question_id string, total_claims int").filter("total_claims = 3").count()
    back = readers.csv(spark, f"{here}/evaluation_details.csv")
    count = lambda name, to: F.col(f"`{name}`").cast("long" if to.startswith(("correct_docs", "relevant", "total_relevant")) else "int").alias(to)
    counts = {"correct_docs_found@5": "correct_docs_found", "relevant_snippets_found@5": "relevant_found", "total_relevant_snippets": "total_relevant", "exact_answer_match": "exact_answer_match", "supported_claims": "supported_claims", "total_claims": "total_claims", "fabricated_claims": "fabricated_claims", "judge_correct_answer": "correct_answer"}
    return back.select(
        F.coalesce("question_id", F.lit("")).alias("question_id"), F.col("`hit_rate@5`").cast("double").alias("hit"), F.round(F.col("reciprocal_rank").cast("double"), 6).alias("reciprocal_rank"), *[count(k, v) for k, v in counts.items()],
        F.round(F.lit(found["groundedness"]), 6).alias("groundedness"), F.lit(judged).cast("long").alias("judged"),
    )


# ---------------------------------------------------------------- providers


def _lengths(path: str, body: dict) -> dict:
    """Embeddings as a service gives them, in any order: a text's length beside a hundred."""
    return {"data": [{"index": i, "embedding": [float(len(x)), 100.0]} for i, x in reversed(list(enumerate(body["input"])))]}


@query("""WITH l AS (SELECT item_id, length(text)::DOUBLE AS l FROM benchmark) SELECT item_id, round(l / sqrt(l * l + 10000), 5) AS a, round(100 / sqrt(l * l + 10000), 5) AS b FROM l""")
def remote_embedding(spark, sf):
    provider = providers.RemoteEmbedder(providers.EmbeddingClient(_lengths, "m"), batch=7, pause=0.0)
    v = providers.embed(t(spark, sf, "benchmark"), provider)
    return v.select("item_id", *[F.round(F.col("vector")[k].cast("double"), 5).alias(n) for k, n in enumerate("ab")])


class _Chat:
    """A service that fails, refuses for now, says nothing, or answers with or without a citation."""

    def __init__(self):
        self.calls = 0

    def __call__(self, path: str, body: dict) -> dict:
        self.calls += 1
        kind = int(body["messages"][-1]["content"].rsplit(" ", 1)[1]) % 5
        if kind == 0:
            raise ConnectionError("down")
        if kind == 1 and self.calls % 2:
            raise providers.RateLimited("0")
        said = {1: "Late. [S1]", 2: " ", 3: "No source.", 4: [{"text": "In  parts "}, {"text": "[S2]"}]}[kind]
        return {"choices": [{"message": {"content": said}}]}


@query("""SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'see [S9]' WHEN 1 THEN 'Late. [S1]' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'see [S9]' ELSE 'In parts [S2]' END AS answer FROM conversations""")
def generated_answers(spark, sf):
    """Answers of a service that fails for some prompts, which then get the short answer, and refuses others at first."""
    asked = t(spark, sf, "conversations").withColumn("messages", answering.messages(F.concat(F.lit("conversation "), F.col("conv_id")), F.col("text")))
    said = providers.generate(asked, providers.ChatClient(_Chat(), "m"), retries=2, pause=0.0)
    fallback = F.lit("see [S9]")
    answer = F.when(F.col("raw_answer").isNull(), fallback).otherwise(answering.guard(F.col("raw_answer"), fallback))
    return said.select("conv_id", "turn", answer.alias("answer"))


@query("""WITH s AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 1) AS x FROM embeddings), r AS (
SELECT q.vec_id AS query_id, c.vec_id AS pos, round(q.x * c.x, 6) + 0.0 AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(q.x * c.x, 6) DESC, c.vec_id) AS rank FROM s q JOIN s c ON q.label = c.label)
SELECT query_id, rank::INT AS rank, pos, score FROM r WHERE rank <= 5""")
def topk_ties(spark, sf):
    """Vectors of one rounded component: most scores tie, and the smaller positions win."""
    v = F.array(F.round(F.col("embedding")[0].cast("double"), 1))
    none = F.lit(None).cast("int")
    e = t(spark, sf, "embeddings")
    plans = e.select(F.col("vec_id").alias("query_id"), v.alias("vector"), F.col("label").alias("year"), none.alias("month"), F.array().cast(dates.PAIRS).alias("date_pairs"))
    chunks = e.select(F.col("vec_id").alias("pos"), v.alias("vector"), F.col("label").alias("year"), F.lit(1).alias("month"))
    return retrieval.retrieve(plans, chunks, 5).select("query_id", "rank", "pos", "score")
