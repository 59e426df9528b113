"""Scoring predictions: relevance, hit rate, reciprocal rank, recall, and what the judge counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import all_year_months
from ..functions.matching import answer_matches
from ..functions.text import collapse, is_missing, normalize_answer, numbers
from ..sources.scratch import stored
from .containment import holders

TOP = 5
CONTEXT_CHARS = 4000
NO_PASSAGES = "(none)"
JUDGE_TASK = (
    "Someone answered a question with the passages below at hand. Take their answer apart into single statements and "
    "reply with one JSON object:\n"
    "- total_claims: how many statements there are;\n"
    "- supported_claims: how many of them a passage states;\n"
    "- fabricated_claims: how many no passage states, or one denies;\n"
    "- correct_answer: 1 if the given answer and the expected one agree, else 0; numbers agree up to one percent, "
    "however they are written;\n"
    "- rationale: one sentence."
)
METRICS = ["hit_rate@5", "mrr", "recall", "groundedness", "factual_accuracy", "hallucination_rate"]
RELEVANCE_COLUMNS = ["source_files", "source_docs", "source_file", "source_doc", "date", "period"]
PAIRS = "array<struct<year:int,month:int>>"


def first_present(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first of the columns that there are and that isn't missing in a row."""
    cols = [F.when(~is_missing(F.col(n)), F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*cols, F.lit(default)) if cols else F.lit(default).cast("string")


def prediction_text(df: DataFrame) -> Column:
    return first_present(df, ["predicted_answer", "prediction", "answer"], "")


def retrieved_ids(df: DataFrame) -> Column:
    """array of chunk ids: from the first column that parses as a list, even an empty one; none otherwise."""
    text = lambda n: F.col(n).cast("string") if dict(df.dtypes)[n] == "string" else F.to_json(n)
    have = lambda names: [n for n in names if n in df.columns]
    arms = [F.from_json(text(n), "array<string>") for n in have(["retrieved_context_ids", "final_context_ids"])]
    nested = "array<struct<chunk_id:string,metadata:struct<chunk_id:string>>>"
    for n in have(["retrieved_context", "final_context"]):
        arms.append(F.filter(F.transform(F.from_json(text(n), nested), lambda x: F.coalesce(F.when(x["chunk_id"] != "", x["chunk_id"]), x["metadata"]["chunk_id"])), lambda c: c.isNotNull()))
    for n in have(["retrieved_sources", "final_sources"]):
        arms.append(F.filter(F.transform(F.from_json(text(n), nested), lambda x: x["chunk_id"]), lambda c: c.isNotNull()))
    return F.coalesce(*arms, F.array().cast("array<string>"))


def with_logs(predictions: DataFrame, logs: DataFrame | None) -> DataFrame:
    """predictions with the columns that only their retrieval log has; a prediction's own columns win, nulls too."""
    if logs is None:
        return predictions
    extra = [c for c in logs.columns if c not in predictions.columns and not c.startswith("_")]
    return predictions.join(logs.select("question_id", *extra), "question_id", "left")


def with_answers(predictions: DataFrame, key: DataFrame) -> DataFrame:
    """predictions with `key_<column>` for each column of their row in the answer key.

    By uid (of equal ones the last), else by row_id as the row's number, else by the question's text (the first).
    key: its columns and _row, each row's number from 0. Each arm is a left join on one key; where several find a row
    the first does. Rows are told apart by _row, so only numbers are joined until the end.
    """
    p = predictions.withColumn("_p", F.monotonically_increasing_id())
    one = lambda by, order: Window.partitionBy(by).orderBy(order)

    def arm(by: str, order: Column, name: str) -> DataFrame:
        return key.filter(F.col(by).isNotNull()).withColumn("_n", F.row_number().over(one(by, order))).filter("_n = 1").select(F.col(by).cast("string").alias(f"_{name}_key"), F.col("_row").alias(f"_{name}"))

    found = []
    if "uid" in key.columns and "question_id" in p.columns:
        p = p.join(arm("uid", F.desc("_row"), "uid"), F.col("question_id").cast("string") == F.col("_uid_key"), "left").drop("_uid_key")
        found.append(F.col("_uid"))
    if "row_id" in p.columns:
        p = p.join(key.select(F.col("_row").alias("_at")), F.col("row_id").cast("double").cast("long") == F.col("_at"), "left")
        found.append(F.col("_at"))
    if "question" in key.columns and "question" in p.columns:
        p = p.join(arm("question", F.col("_row"), "text"), F.col("question") == F.col("_text_key"), "left").drop("_text_key")
        found.append(F.col("_text"))
    row = F.coalesce(*found) if found else F.lit(None).cast("long")
    drop = [c for c in ("_uid", "_at", "_text") if c in p.columns]
    p = p.withColumn("_found", row).drop(*drop)
    renamed = key.select(F.col("_row").alias("_found"), *[F.col(c).alias(f"key_{c}") for c in key.columns if c != "_row"])
    return p.join(renamed, "_found", "left").drop("_found", "_p")


def relevant_pairs(df: DataFrame, prefix: str = "key_") -> Column:
    """array of struct(year, month): those of the answer key's source columns, else of the prediction's own dates."""
    named = [F.coalesce(F.when(~is_missing(F.col(prefix + c)), all_year_months(F.col(prefix + c).cast("string"))), F.array().cast(PAIRS)) for c in RELEVANCE_COLUMNS if prefix + c in df.columns]
    own = []
    for y, m in (("year", "month"), ("detected_year", "detected_month")):
        if y in df.columns and m in df.columns:
            year, month = (F.col(c).try_cast("double").cast("int") for c in (y, m))
            own.append(F.when(year.isNotNull() & month.isNotNull(), F.array(F.struct(year.alias("year"), month.alias("month")))).otherwise(F.array().cast(PAIRS)))
    union = lambda parts: F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast(PAIRS)
    return F.when(F.size(union(named)) > 0, union(named)).otherwise(union(own))


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, year, month, norm_text, text_numbers: each text normalised once, not once for each question."""
    return chunks.select("chunk_id", "year", "month", normalize_answer(F.col("text")).alias("norm_text"), numbers(F.col("text")).alias("text_numbers"))


def relevant_chunks(gold: DataFrame, prepared: DataFrame) -> DataFrame:
    """question_id, chunk_id, year, month: chunks that count as relevant. A row whose chunk_id is null stands for every chunk
    of its month, or for all chunks if it has none; see every_relevant_chunk().

    gold: question_id, gold_answer, pairs. Candidates are the chunks of the pairs, all chunks without any; of those
    the ones that hold the answer, or all candidates if none does. Questions and chunks meet in an index of the answers
    only, so what is made is what is found, and a row for each date of a question whose answer is nowhere.
    """
    g = gold.select("question_id", F.array_distinct("pairs").alias("pairs"), normalize_answer(F.col("gold_answer")).alias("an"), numbers(F.col("gold_answer")).alias("ann"))
    dates = g.select("question_id", "an", "ann", F.explode_outer("pairs").alias("_d")).select("question_id", "an", "ann", "_d.year", "_d.month")
    found = stored(holders(dates, prepared), "relevant")
    none = dates.join(found.select("question_id").distinct(), "question_id", "left_anti").select("question_id", "year", "month").distinct()
    date = lambda c: F.lit(None).cast("int").alias(c)
    chunk = F.lit(None).cast(dict(prepared.dtypes)["chunk_id"]).alias("chunk_id")
    return found.select("question_id", "chunk_id", date("year"), date("month")).unionByName(none.select("question_id", chunk, "year", "month"))


def every_relevant_chunk(relevant: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_id of relevant_chunks() with each chunk that a row stands for: for reports of some questions."""
    named = relevant.filter("chunk_id IS NOT NULL").select("question_id", "chunk_id")
    rest, ids = relevant.filter("chunk_id IS NULL").drop("chunk_id"), chunks.select("chunk_id", "year", "month").distinct()
    months = rest.filter("year IS NOT NULL").join(ids, ["year", "month"]).select("question_id", "chunk_id")
    free = rest.filter("year IS NULL").select("question_id", F.lit(1).alias("_all")).join(ids.select("chunk_id", F.lit(1).alias("_all")), "_all").select("question_id", "chunk_id")
    return named.unionByName(months).unionByName(free).distinct()


def retrieval_scores(retrieved: DataFrame, chunks: DataFrame, relevant: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, hit, correct_docs_found, reciprocal_rank, relevant_found, total_relevant of the top five.

    retrieved: question_id, ids. relevant: as relevant_chunks() has it. Hits and ranks look at the first five ids that are chunks and at their documents'
    dates (their ids, for questions without pairs); recall at the first five ids as they are. A chunk id is of one month.
    """
    each = retrieved.select("question_id", F.posexplode("ids").alias("at", "chunk_id"))
    once = chunks.groupBy("chunk_id").agg(F.max_by(F.struct("year", "month"), "pos").alias("d"))
    known = each.join(once, "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))).filter(F.col("rank") <= TOP)
    named, every = relevant.filter("chunk_id IS NOT NULL"), relevant.filter("chunk_id IS NULL")
    stands = every.select("question_id").distinct().withColumn("every", F.lit(True))
    asked = gold.select("question_id", F.array_distinct("pairs").alias("pairs")).join(stands, "question_id", "left")
    judged = known.join(asked, "question_id").join(named.select("question_id", "chunk_id", F.lit(True).alias("rel")), ["question_id", "chunk_id"], "left")
    by_date = F.exists("pairs", lambda p: (p["year"] == F.col("d.year")) & (p["month"] == F.col("d.month")))
    right = F.when(F.size("pairs") > 0, by_date).otherwise(F.coalesce("rel", "every", F.lit(False)))
    what = F.when(F.size("pairs") > 0, F.concat_ws("-", "d.year", "d.month")).otherwise(F.col("chunk_id").cast("string"))
    hits = judged.withColumn("_right", right).groupBy("question_id").agg(F.count_distinct(F.when(F.col("_right"), what)).alias("correct_docs_found"), F.coalesce(F.lit(1.0) / F.min(F.when(F.col("_right"), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))
    top = each.filter(F.col("at") < TOP).select("question_id", "chunk_id").distinct()
    # Ids of questions whose answer is nowhere count if they are chunks of the question's months, or chunks at all.
    in_every = top.join(asked.filter("every"), "question_id").join(once, "chunk_id").filter((F.size("pairs") == 0) | by_date).select("question_id", "chunk_id")
    found = top.join(named, ["question_id", "chunk_id"], "left_semi").unionByName(in_every).groupBy("question_id").agg(F.count(F.lit(1)).alias("relevant_found"))
    total = named.groupBy("question_id").agg(F.count(F.lit(1)).alias("_named"))
    months = chunks.groupBy("year", "month").agg(F.count_distinct("chunk_id").alias("_n"))
    of_months = every.join(months, ["year", "month"]).groupBy("question_id").agg(F.sum("_n").alias("_of_months"))
    all_chunks = chunks.select(F.count_distinct("chunk_id").alias("n")).scalar()
    out = asked.join(hits, "question_id", "left").join(found, "question_id", "left").join(total, "question_id", "left").join(of_months, "question_id", "left")
    total_relevant = F.when(F.col("every") & (F.size("pairs") == 0), all_chunks).when(F.col("every"), F.col("_of_months")).otherwise(F.col("_named"))
    out = out.withColumn("total_relevant", total_relevant).drop("every", "pairs", "_named", "_of_months")
    out = out.fillna(0, ["correct_docs_found", "relevant_found", "total_relevant"]).fillna(0.0, ["reciprocal_rank"])
    return out.withColumn("hit", F.when(F.col("correct_docs_found") > 0, 1.0).otherwise(0.0))


def ratio(top: Column, bottom: Column, default: float) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(default))


def metrics(details: DataFrame) -> DataFrame:
    """One row of the six metrics. Hit rate and reciprocal rank are means over questions, the others ratios of sums."""
    s = lambda c: F.sum(c)
    return details.agg(
        F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_rate@5"),
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        ratio(s("relevant_found"), s("total_relevant"), 0.0).alias("recall"),
        ratio(s("supported_claims"), s("total_claims"), 1.0).alias("groundedness"),
        ratio(s("correct_answer"), F.count(F.lit(1)), 0.0).alias("factual_accuracy"),
        ratio(s("fabricated_claims"), s("total_claims"), 0.0).alias("hallucination_rate"),
    )


def judge_prompt(question: Column, answer: Column, contexts: Column, gold: Column) -> Column:
    """contexts: array of texts, each clipped."""
    shown = F.transform(contexts, lambda c, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), F.substring(collapse(c), 1, CONTEXT_CHARS)))
    block = F.when(F.size(contexts) > 0, F.array_join(shown, "\n\n")).otherwise(F.lit(NO_PASSAGES))
    parts = [F.lit(JUDGE_TASK), F.lit("\n\n# Question\n\n"), question, F.lit("\n\n# Expected\n\n"), gold, F.lit("\n\n# Given\n\n"), answer, F.lit("\n\n# Passages\n\n"), block]
    return F.concat(*parts)


def exact_match(prediction: Column, gold: Column) -> Column:
    return answer_matches(prediction, gold).cast("int")
