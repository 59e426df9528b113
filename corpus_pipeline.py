"""From raw documents to token ids: quality, line dedup, near-dedup, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. A stage works on all rows of the
one before, and its decisions take effect in the rows or texts that it returns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import line_dedup, mixing, pieces, quality, wide_simhash
from corvane.llm.common import materialise, small_batches, table, text_slices

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the classifier rejects (score below its threshold); null ids and texts are scored too."""
    docs = _columns(docs)
    model = quality.train(docs, quality.labels_of(spark, sf_dir))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches):
        for b in text_slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            s = shared.value.score(np.array([shared.value.measure(t or b"") for t in texts]).reshape(-1, 5))
            yield b.filter(pa.array(s >= quality.THRESHOLD))

    # Scored in the pass that filters: joining scores back by id would shuffle the texts.
    return docs.mapInArrow(keep, docs.schema)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose bits are off; n_chars follows."""
    docs = _columns(docs)
    bitmaps = line_dedup.changed_bitmaps(docs)
    rest = docs.withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).withColumnRenamed("doc_id", "_id")
    both = line_dedup._join(rest, bitmaps.select("_id", "_row", "keep_bitmap"))

    def cut(batches):
        for b in text_slices(batches):
            out = [t if m is None or t is None else line_dedup.kept_text(t, m) for t, m in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("keep_bitmap").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, pa.binary()).cast(pa.string()), b.column("lang"), b.column("source")], ["doc_id", "text", "lang", "source"])

    kind = dict(docs.dtypes)
    cut_rows = both.select("_id", "text", "lang", "source", "keep_bitmap").mapInArrow(cut, ", ".join(f"{c} {kind[c]}" for c in COLUMNS[:4]))
    return cut_rows.withColumn("n_chars", F.length("text").cast(kind["n_chars"])).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, the one with the smallest id (null ids last).

    Near: 64-bit fingerprints link, or sets of five-word shingles have a Jaccard similarity of 0.8 or more. Rows are
    told apart by a number of their own, so rows that share an id, or have none, go only if their texts are near.
    """
    rows = wide_simhash.numbered(_columns(docs))
    stay = materialise(wide_simhash.survivors(wide_simhash.grouped(rows)), "near-dup-stay")
    return rows.join(stay.hint("shuffle_hash"), "_rid").select(*COLUMNS)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text's words lo..hi-1 of each span, with the white space between them; spans that meet are joined."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, last = [], None
    for lo, hi in sorted(spans):
        if last is not None and lo == last[1]:
            last[1] = hi
        else:
            out.append(last := [lo, hi])
    if out == [[0, len(words)]]:
        return text
    return "\n".join(text[words[lo][0] : words[hi - 1][1]] for lo, hi in out)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: one row for a document's blocks of each pass over its source, two at most.

    Where all of a document's blocks are taken, the text stays as it is. Documents without words aren't taken.
    """
    docs = _columns(docs)
    measured = mixing.measure(docs, keep=["text", "lang"])
    taken, _ = mixing.mix(measured)
    spans = taken.groupBy("_rid", "epoch").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    both = spans.hint("shuffle_hash").join(measured.select("_rid", "_id", "text", "lang", "_source"), "_rid")

    def cut(batches):
        for b in text_slices(batches):
            texts = [cut_words(t, [(s["lo"], s["hi"]) for s in ss]) for t, ss in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("_source")], ["doc_id", "text", "lang", "source"])

    small_batches(spark)
    kind = dict(docs.dtypes)
    rows = both.select("_id", "text", "lang", "_source", "spans").mapInArrow(cut, ", ".join(f"{c} {kind[c]}" for c in COLUMNS[:4]))
    return rows.withColumn("n_chars", F.length("text").cast(kind["n_chars"])).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of each row."""
    return pieces.encode(docs, check=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]
#: SentencePiece can't be expressed in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
