"""Writing: every writer commits as a whole, so a failed run leaves no partial artifact."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import check_dimensions

# Columns of predictions and details, and keys of a manifest, as other programs read them.
PREDICTION_COLUMNS = ["question_id", "question", "gold_answer", "predicted_answer", "detected_year", "detected_month", "retrieval_method"]
DETAIL_COLUMNS = [
    "question_id", "hit_rate@5", "correct_docs_found@5", "reciprocal_rank", "relevant_snippets_found@5", "total_relevant_snippets",
    "factual_accuracy", "exact_answer_match", "judge_correct_answer", "supported_claims", "total_claims", "fabricated_claims",
]
MANIFEST_KEYS = [
    "vector_db_type", "index_backend", "shared_index", "metadata_scope", "metadata_filtering", "embedding_backend",
    "embedding_model_name", "embedding_dim", "normalize_embeddings", "chunk_count", "document_count", "selected_years",
    "document_years", "chunk_size", "chunk_overlap", "top_k",
]


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of text and metadata."""
    chunks.select("text", "metadata").write.mode("overwrite").json(path)


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite", more: tuple = ()) -> None:
    """Chunks with their vectors, by year and month (and more columns): filters on either prune folders.

    Mode merge replaces the partitions that chunks has rows of, as a whole, and leaves all others alone. Mode append adds to an index, whose vectors' length the new ones must have; a row that hasn't fails the write, which
    then adds nothing.
    """
    out = chunks.withColumns({"year": F.col("metadata.year"), "month": F.col("metadata.month")})
    if mode == "append":
        there = chunks.sparkSession.read.parquet(path).agg(F.max(F.size("vector")).alias("d")).first()["d"]
        out = check_dimensions(out, "vector", there) if there else out
    if mode == "merge":
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", *more).parquet(path)
    else:
        out.write.mode(mode).partitionBy("year", "month", *more).parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; texts come back as they were, blanks at their ends, quotes and line feeds included."""
    rows.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_predictions(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(rows.select(*PREDICTION_COLUMNS), path, mode)


def without_done(questions: DataFrame, done: DataFrame, key: str | list[str] = "question_id") -> DataFrame:
    """Questions that no earlier run has answered: how an interrupted run is taken up again."""
    names = [key] if isinstance(key, str) else key
    return questions.join(done.select(*names), names, "left_anti")


def committed(spark, path: str) -> list[str]:
    """The folders two levels below path whose write has come to its end, in order; nothing if path isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(x.getPath().getParent()) for x in found or ())


def exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark, path: str, folder: str) -> None:
    """What lies at path into a folder, which is made if there is none; nothing if path isn't there."""
    at, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, folder))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return
    fs.mkdirs(to)
    if not fs.rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, at.getName())):
        raise OSError(f"{path} can't be moved to {folder}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_details(details: DataFrame, path: str) -> None:
    write_csv(details.select(*DETAIL_COLUMNS), path)


def write_one(spark, value: dict, path: str) -> None:
    """One JSON object, keys in order, as one small file; an older one is replaced in one step by the complete new one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    new = jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()
    replace = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = replace
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(at), options)


def keep_only(spark, path: str, names: list[str]) -> None:
    """Delete all that lies in a folder but what bears one of the names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        if f.getPath().getName() not in names:
            fs.delete(f.getPath(), True)
