"""The three runs: build an index, answer questions, evaluate answers. Each is one DataFrame plan from scan to sink."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions.text import strip
from ..operators import answering, chunking, evaluation, long_documents, retrieval
from ..sources import npy, readers, sinks
from ..sources.scratch import scratch
from .config import RUN_MODES


def _model(settings: dict) -> str:
    if not settings.get("model"):
        raise ValueError(f"backend {settings['backend']} needs a model")
    return settings["model"]


#: What the manifest calls an index that this module reads.
INDEX_BACKEND = "parquet_flat_ip"


def embedder(config: dict):
    e = config["embedding"]
    if e["backend"] == "hash":
        return providers.HashEmbedder(int(e.get("dim", 256)))
    if e["backend"] == "keyword":
        return providers.KeywordEmbedder(e["words"])
    post = providers.EmbeddingClient(providers.endpoint(e), _model(e))
    return providers.RemoteEmbedder(post, name=e["model"], batch=e["batch_size"], retries=e["max_retries"], pause=e["retry_sleep_seconds"], before=e["request_sleep_seconds"])


def generator(g: dict):
    """What answers a prompt; None for the extractive backend, which asks no one."""
    if g["backend"] == "extractive":
        return None
    return providers.ChatClient(providers.endpoint(g), _model(g), g["temperature"], g["max_tokens"], g.get("num_ctx"))


def judge(g: dict):
    """What judges an answer: the generator's service, at temperature zero, asked for JSON."""
    if g["backend"] == "extractive":
        raise ValueError("judging needs a generation backend, or recorded verdicts")
    return providers.JudgeClient(providers.endpoint(g), _model(g), g["max_tokens"])


def settings_hash(config: dict) -> str:
    """Of what an index depends on: an index built with other settings isn't used."""
    used = {k: config[k] for k in ("data_dir", "document_years", "chunk_size", "chunk_overlap", "embedding")}
    return hashlib.sha256(json.dumps(used, sort_keys=True, default=str).encode()).hexdigest()


def chunk_table(docs: DataFrame, config: dict) -> DataFrame:
    """Chunks in corpus order: pos is made of the document's place and the chunk's."""
    return _positioned(chunking.chunk_documents(docs, config["chunk_size"], config["chunk_overlap"], required="source_path"))


def piece_table(pieces: DataFrame, docs: DataFrame, config: dict, path: str) -> DataFrame:
    """chunk_table() of documents whose texts are stored in pieces. docs: long_documents.documents() with doc_pos. The pieces are
    read before this returns, and stored at path as they are taken apart, where the chunks come from."""
    marked = long_documents.store_pieces(long_documents.marked(readers.spread(pieces), docs), path)
    rows = long_documents.chunk_pieces(marked, config["chunk_size"], config["chunk_overlap"])
    return _positioned(rows.join(docs.select("source_path", "year", "month", "doc_pos"), "source_path"))


def _positioned(rows: DataFrame) -> DataFrame:
    meta = F.struct("year", "month", "source_path", chunking.chunk_id(F.col("year"), F.col("month"), F.col("chunk_no")).alias("chunk_id"), "heading", "content_type")
    return rows.select("text", meta.alias("metadata"), (F.col("doc_pos") * 10_000_000 + F.col("chunk_no")).alias("pos"))


def manifest(index: DataFrame, config: dict, provider) -> DataFrame:
    """One row: counts and dimension from the index, settings from the configuration."""
    counted = index.agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("metadata.source_path").alias("document_count"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("embedding_dim"))
    return manifest_row(counted, config, provider)


def manifest_row(counted: DataFrame, config: dict, provider) -> DataFrame:
    """The manifest of a row of chunk_count, document_count, embedding_dim."""
    known = {
        "vector_db_type": config["vector_db_type"], "index_backend": INDEX_BACKEND, "shared_index": True, "metadata_scope": "superset",
        "metadata_filtering": "retrieval_time_only", "embedding_backend": provider.backend, "embedding_model_name": provider.name,
        "normalize_embeddings": bool(config["embedding"]["normalize"]), "chunk_size": config["chunk_size"], "chunk_overlap": config["chunk_overlap"], "top_k": config["top_k"],
    }
    years = {k: F.array(*[F.lit(y) for y in config[k]]) for k in ("selected_years", "document_years")}
    return counted.withColumns({k: F.lit(v) for k, v in known.items()} | years).select(*sinks.MANIFEST_KEYS, F.lit(settings_hash(config)).alias("settings_hash"))


def build_index(spark: SparkSession, config: dict, provider=None) -> DataFrame:
    """Documents to chunks to vectors, written under index_dir; returns the manifest's row.

    Files are read by their splits and chunked in pieces, as streams do it: no task holds one, however long it is.
    """
    provider = provider or embedder(config)
    apart, marked = scratch(spark, "pieces"), scratch(spark, "marked")
    pieces, docs = readers.document_pieces(spark, config["data_dir"], config["document_years"], apart)
    index = providers.embed(piece_table(pieces, docs, config, marked), provider, normalize=config["embedding"]["normalize"])
    sinks.remove(spark, apart)
    root = config["index_dir"]
    sinks.remove(spark, f"{root}/documents")  # of a streamed index that this one replaces
    sinks.write_index(index, f"{root}/index")
    sinks.remove(spark, marked)
    return finish_index(spark, config, provider)


def finish_index(spark: SparkSession, config: dict, provider) -> DataFrame:
    """Writes the chunk file and the manifest of the index that is there; returns the manifest's row."""
    root = config["index_dir"]
    there = load_index(spark, root)
    sinks.write_chunks(there.orderBy("pos"), f"{root}/chunks.jsonl")
    row = manifest(there, config, provider)
    sinks.write_one(spark, row.first().asDict(recursive=True), f"{root}/manifest.json")
    return row


def load_index(spark: SparkSession, index_dir: str) -> DataFrame:
    return spark.read.parquet(f"{index_dir}/index")


def read_manifest(spark: SparkSession, index_dir: str) -> dict:
    """The manifest beside an index; nothing without one."""
    path = f"{index_dir}/manifest.json"
    found = spark.read.option("multiLine", True).json(path).limit(1).collect() if sinks.exists(spark, path) else []
    return found[0].asDict(recursive=True) if found else {}


def index_matches(spark: SparkSession, config: dict) -> bool:
    """Whether there is an index that was built with these settings."""
    return read_manifest(spark, config["index_dir"]).get("settings_hash") == settings_hash(config)


def check_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The index, which has to be of the known kind and to hold what its manifest and its chunk file say."""
    said = read_manifest(spark, index_dir)
    if said.get("index_backend") != INDEX_BACKEND:
        raise readers.DataError(f"the index in {index_dir} is of the kind {said.get('index_backend')}, not {INDEX_BACKEND}")
    index, size = load_index(spark, index_dir), F.size("vector")
    n = index.agg(F.count(F.lit(1)).alias("chunk_count"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    # A streamed index has a register instead, until its chunk file is written.
    texts = readers.chunks(spark, f"{index_dir}/chunks.jsonl").count() if sinks.exists(spark, f"{index_dir}/chunks.jsonl") else n["chunk_count"]
    if not n["chunk_count"] == texts == said["chunk_count"]:
        raise readers.DataError(f"the index in {index_dir} holds {n['chunk_count']} vectors and {texts} chunks; its manifest says {said['chunk_count']}")
    if {n["least"], n["most"]} != {said["embedding_dim"]}:
        raise readers.DataError(f"vectors of {n['least']} to {n['most']} components; the manifest says {said['embedding_dim']}")
    return index


def model_config(config: dict, provider) -> str:
    """Of a run, for its log. The keys, as other programs read them."""
    g = config["generation"]
    said = {
        "pipeline": "metadata_rag" if config["metadata_enabled"] else "baseline_rag", "chunk_size": config["chunk_size"], "chunk_overlap": config["chunk_overlap"],
        "embedding_model": provider.name, "retrieval": "exact_vector_top_k", "top_k": config["top_k"], "metadata_filtering": config["metadata_enabled"],
        "generation_backend": g["backend"], "generation_model": g.get("model", "extractive") if g["backend"] != "extractive" else "extractive", "generation": g,
    }
    return json.dumps(said, sort_keys=True)


def search(planned: DataFrame, index: DataFrame, config: dict, provider, k: int | None = None) -> DataFrame:
    """query_id, rank, pos, score of the k best chunks for each planned question; 0 and None mean the settings' top_k.

    planned: query_id, question, year, month, date_pairs. A blank question is an error. A question that no chunk fits
    isn't embedded and has no rows.
    """
    k = k or config["top_k"]
    if k < 0:
        raise ValueError("k must not be negative")
    chunks = index.select("pos", "vector", F.col("metadata.year").alias("year"), F.col("metadata.month").alias("month"))
    blank = F.coalesce(strip(F.col("question")), F.lit("")) == ""
    told = planned.withColumn("question", F.when(~blank, F.col("question")).otherwise(F.raise_error(F.lit("a question must not be empty")).cast("string")))
    dates = chunks.select("year", "month").distinct().select(F.col("year").alias("cy"), F.col("month").alias("cm"))
    some = told.join(dates, retrieval.matches(F.col("date_pairs"), F.col("year"), F.col("month"), F.col("cy"), F.col("cm")), "left_semi")
    asked = providers.embed(some.select("query_id", "question", "year", "month", "date_pairs"), provider, "question", "vector", config["embedding"]["normalize"])
    return retrieval.retrieve(asked, chunks, k)


def retrieved(questions: DataFrame, index: DataFrame, config: dict, provider) -> DataFrame:
    """The chunks of each question, with their texts and metadata: one search and one look-up in the index for all questions."""
    planned = retrieval.plan(questions.withColumn("query_id", F.col("_row")), RUN_MODES[config["mode"]], config["selected_years"])
    return search(planned, index, config, provider).join(index.select("pos", "text", "metadata.*"), "pos")


def answer(questions: DataFrame, index: DataFrame, config: dict, provider, call=None, journal: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Every question at once: plan, embed, retrieve, cite, answer. Questions without a chunk get NOT_FOUND.

    hits: what retrieved() has found for these questions before, if it has. The columns of predictions and, for the log, final_context_ids, final_sources, final_context; question_no tells rows
    apart.
    """
    g = config["generation"]
    planned = retrieval.plan(questions.withColumn("query_id", F.col("_row")), RUN_MODES[config["mode"]], config["selected_years"])
    hits = hits if hits is not None else retrieved(questions, index, config, provider)
    fields = answering.METADATA_FIELDS if config["metadata_enabled"] else answering.BASE_FIELDS
    hits = hits.withColumnRenamed("query_id", "question_no")
    context = answering.context_blocks(answering.snippets(hits, g["max_context_chars"], fields, "question_no"), "question_no")
    held = answering.collect_hits(hits, ["score", "text", "chunk_id", "source_path", "year", "month", "heading", "content_type"], "question_no")
    rows = planned.drop("year", "month").join(held, planned["query_id"] == held["question_no"], "left").drop("question_no").join(context.withColumnRenamed("question_no", "_q"), F.col("query_id") == F.col("_q"), "left").drop("_q")
    short = answering.extractive(F.col("hits"), F.col("question"))
    if g["backend"] == "extractive":
        rows = rows.withColumn("predicted_answer", short)
    else:
        ready = rows.withColumn("messages", F.when(F.col("hits").isNotNull(), answering.messages(F.col("question"), F.col("context"))))
        rows = providers.generate(ready, call or generator(g), retries=g["max_retries"], pause=g["retry_sleep_seconds"], before=g["request_sleep_seconds"], in_flight=g["requests_in_flight"], journal=journal)
        failed = short if g["allow_extractive_fallback"] else F.raise_error(F.lit("the answer provider failed")).cast("string")
        guarded = answering.guard(F.col("raw_answer"), short, g["require_citations"], g["fallback_on_ungrounded_answer"])
        rows = rows.withColumn("predicted_answer", F.when(F.col("hits").isNull(), answering.NOT_FOUND).when(F.col("raw_answer").isNull(), failed).otherwise(guarded))
    none = F.coalesce(F.col("hits"), F.array().cast(dict(rows.dtypes)["hits"]))
    record = lambda h: [h["chunk_id"].alias("chunk_id"), h["source_path"].alias("source_path"), h["year"].alias("year"), h["month"].alias("month"), h["heading"].alias("heading"), h["content_type"].alias("content_type")]
    return rows.select(
        "question_id", "question", "gold_answer", "predicted_answer", "detected_year", "detected_month", F.lit(f"{config['mode']}_vector_top_k").alias("retrieval_method"),
        F.array(*[F.lit(y) for y in config["selected_years"]]).alias("selected_years"), F.lit(model_config(config, provider)).alias("model_config"),
        F.transform(none, lambda h: h["chunk_id"]).alias("final_context_ids"),
        F.transform(none, lambda h: F.struct(*record(h), h["score"].alias("vector_score"))).alias("final_sources"),
        F.transform(none, lambda h: F.struct(*record(h), h["text"].alias("text"))).alias("final_context"),
        F.col("query_id").alias("question_no"),
    )


LOG_COLUMNS = ["question_id", "selected_years", "detected_year", "detected_month", "retrieval_method", "model_config", "final_context_ids", "final_sources", "final_context"]


def run_qa(spark: SparkSession, config: dict, provider=None, call=None, resume: bool = False, most_slices: int | None = None) -> DataFrame:
    """Answers the selected years' questions into output_dir; builds the index first if there is none of these settings.

    Questions are answered in slices of generation.slice_questions rows, each written and committed on its own: a run
    that is killed or fails loses the slice it was at, and what was paid for before stays. resume: questions that earlier
    runs with these settings have answered aren't asked again, whether those runs ended well or not; without it all are
    asked. most_slices: stop after so many. Predictions and logs then hold what is answered so far.

    What the questions retrieve is looked for once, before the first slice, so the index is scanned once, however many slices
    there are: they are a matter of how much may be lost.
    """
    provider = provider or embedder(config)
    if not index_matches(spark, config):
        build_index(spark, config, provider)
    questions = readers.questions_of_years(readers.answer_key(spark, config["csv_path"]), config["selected_years"])
    root = config["output_dir"]
    # The folder bears the settings' names, so that answers of other settings are never taken for done.
    path = f"{root}/answers-{run_hash(config)}"
    # Replies are kept one by one where workers can open the folder, until their slice is committed.
    journal = npy.local(f"{root}/journal-{run_hash(config)}") if "://" not in root or root.startswith("file://") else None
    if not resume:
        sinks.remove(spark, path)
    asked = [F.col("_row").alias("question_no"), "question"]
    done = sinks.committed(spark, path)
    left = questions
    if done:
        left = sinks.without_done(questions, spark.read.parquet(*done).select(F.col("question_no").alias("_row"), "question"), ["_row", "question"])
    todo = _written(left.withColumn("_slice", F.floor(F.col("_row") / config["generation"]["slice_questions"])), f"{root}/questions-{run_hash(config)}", "_slice")
    numbers = sorted(r[0] for r in todo.select("_slice").distinct().collect())
    index = check_index(spark, config["index_dir"]) if numbers else None
    if numbers[:most_slices]:
        # The index is searched once for all slices of this run; a slice reads its own hits.
        now = todo.filter(F.col("_slice") <= numbers[:most_slices][-1])
        slices = now.select(F.col("_row").alias("query_id"), "_slice")
        hits = _written(retrieved(now.drop("_slice"), index, config, provider).join(slices, "query_id"), scratch(spark, "hits"), "_slice")
    for k in numbers[:most_slices]:
        own = F.col("_slice") == k
        out = answer(todo.filter(own).drop("_slice"), index, config, provider, call, f"{journal}/after-{len(done)}-slice-{k}" if journal else None, hits.filter(own).drop("_slice"))
        out.write.mode("overwrite").parquet(f"{path}/after-{len(done)}/slice-{k}")
        if journal:
            sinks.remove(spark, f"file://{journal}/after-{len(done)}-slice-{k}")
    stored = sinks.committed(spark, path)
    # An answer key that has changed since leaves answers that no question asks for.
    answers = spark.read.parquet(*stored).join(questions.select(*asked), ["question_no", "question"], "left_semi")
    sinks.write_predictions(answers, f"{root}/predictions.csv")
    sinks.write_json(answers.select(*LOG_COLUMNS), f"{root}/retrieval_logs.jsonl")
    return answers


def _written(rows: DataFrame, path: str, by: str) -> DataFrame:
    """rows written by a column's values and read again, also if there are none."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_hash(config: dict) -> str:
    """Of all that an answer depends on."""
    used = {k: v for k, v in config.items() if k not in ("output_dir", "index_dir")}
    used["generation"] = {k: v for k, v in config["generation"].items() if k not in ("slice_questions", "requests_in_flight")}
    return hashlib.sha256(json.dumps(used, sort_keys=True, default=str).encode()).hexdigest()[:16]


def evaluate(predictions: DataFrame, logs: DataFrame | None, chunks: DataFrame, key: DataFrame, judge_call, retries: int = 3, pause: float = 5.0, before: float = 0.0) -> DataFrame:
    """One row of details for each prediction, also where several share an id or have none.

    predictions: as readers.predictions() has them; _row tells them apart. chunks: chunk_id, text, year, month, pos.
    """
    p = evaluation.with_answers(evaluation.with_logs(predictions, logs), key)
    qid = evaluation.first_present(p, ["question_id", "row_id"], "")
    gold = F.coalesce(evaluation.first_present(p, ["gold_answer"]), evaluation.first_present(p, ["key_answer"], ""))
    asked = F.coalesce(evaluation.first_present(p, ["question"]), evaluation.first_present(p, ["key_question"], ""))
    # Scores are by the prediction's row, which the scoring functions take for the question.
    rows = p.select(F.col("_row").alias("question_id"), qid.alias("_said_id"), asked.alias("question"), gold.alias("gold_answer"), evaluation.prediction_text(p).alias("prediction"), evaluation.retrieved_ids(p).alias("ids"), evaluation.relevant_pairs(p).alias("pairs"))
    # Written once: half a dozen joins below start from it.
    path = scratch(chunks.sparkSession, "evaluate")
    rows.write.parquet(path)
    base = chunks.sparkSession.read.schema(rows.schema).parquet(path)
    relevant = evaluation.relevant_chunks(base, evaluation.prepare_chunks(chunks))
    scores = evaluation.retrieval_scores(base, chunks, relevant, base)
    each = base.select("question_id", F.posexplode("ids").alias("at", "chunk_id"))
    named = chunks.join(each.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by("text", "pos").alias("text"))
    texts = each.join(named, "chunk_id").groupBy("question_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), 1, evaluation.TOP).alias("contexts"))
    ready = base.join(texts, "question_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    prompt = evaluation.judge_prompt(F.col("question"), F.col("prediction"), F.col("contexts"), F.col("gold_answer"))
    if isinstance(judge_call, providers.RecordedJudge):
        judged = providers.recorded_verdicts(ready, judge_call)
    else:
        judged = providers.judge(ready.withColumn("prompt", prompt), judge_call, retries=retries, pause=pause, before=before)
    exact = evaluation.exact_match(F.col("prediction"), F.col("gold_answer")).alias("exact_answer_match")
    return judged.join(scores, "question_id").select(F.col("_said_id").alias("question_id"), "hit", "correct_docs_found", "reciprocal_rank", "relevant_found", "total_relevant", exact, "verdict.*")


def run_evaluation(spark: SparkSession, config: dict, judge_call=None, predictions_path: str | None = None) -> dict:
    """Evaluates output_dir's predictions: metrics.json, evaluation_details.csv and judge_results.jsonl in a folder of this
    run's own below output_dir/evaluations.

    evaluation.json names the folder and is replaced last, in one step: whoever goes by it sees all artifacts of one run,
    whatever fails in between; see evaluation_folder(). Earlier folders are deleted then. If the judge fails,
    judge_error.json says how and nothing else changes; a success removes it.
    """
    root, g = config["output_dir"], config["generation"]
    judge_call = judge_call or judge(g)
    stored = readers.chunks(spark, f"{config['index_dir']}/chunks.jsonl")
    chunks = stored.select(F.col("metadata.chunk_id").alias("chunk_id"), "text", F.col("metadata.year").alias("year"), F.col("metadata.month").alias("month"), "pos")
    logs = readers.retrieval_logs(spark, f"{root}/retrieval_logs.jsonl")
    details = evaluate(readers.predictions(spark, predictions_path or f"{root}/predictions.csv"), logs, chunks, readers.answer_key(spark, config["csv_path"]), judge_call, g["max_retries"], g["retry_sleep_seconds"], g["request_sleep_seconds"])
    name = f"evaluations/{uuid.uuid4().hex}"
    here = f"{root}/{name}"
    try:
        details.write.parquet(f"{here}/details")  # the judge is asked once
    except Exception as e:
        sinks.write_one(spark, {"error": str(e)[:2000]}, f"{root}/judge_error.json")
        sinks.remove(spark, here)
        raise
    details = spark.read.parquet(f"{here}/details")
    found = evaluation.metrics(details).first().asDict()
    named = {"hit": "hit_rate@5", "correct_docs_found": "correct_docs_found@5", "relevant_found": "relevant_snippets_found@5", "total_relevant": "total_relevant_snippets"}
    shown = details.withColumnsRenamed(named).withColumns({"factual_accuracy": F.col("correct_answer"), "judge_correct_answer": F.col("correct_answer")})
    sinks.write_details(shown, f"{here}/evaluation_details.csv")
    sinks.write_json(shown.select("question_id", "supported_claims", "total_claims", "fabricated_claims", "judge_correct_answer", "raw_response"), f"{here}/judge_results.jsonl")
    sinks.write_one(spark, {k: found[k] for k in evaluation.METRICS}, f"{here}/metrics.json")
    sinks.write_one(spark, {"folder": name}, f"{root}/evaluation.json")
    sinks.remove(spark, f"{root}/judge_error.json")
    sinks.keep_only(spark, f"{root}/evaluations", [name.split("/")[1]])
    return found


def evaluation_folder(spark: SparkSession, output_dir: str) -> str:
    """Where the artifacts of the last whole evaluation are."""
    path = f"{output_dir}/evaluation.json"
    if not sinks.exists(spark, path):
        raise readers.DataError(f"no evaluation in {output_dir}")
    return f"{output_dir}/{spark.read.option('multiLine', True).json(path).first()['folder']}"
