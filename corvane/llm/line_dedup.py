"""Line dedup over hashes of lines (operator 7).

Hashes are range-partitioned with a secondary sort by document and position; a stream over each partition takes the
first occurrence of each hash and counts its documents. What comes back is a compressed keep bitmap per document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, small_batches, table, text_slices

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    """bytes.strip and bytes.lower know ASCII only: white space [\\x20\\x09-\\x0D] at both ends, A-Z."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _hash_lines(min_chars: int):
    def run(batches):
        for b in text_slices(batches):
            hi, lo, rows, pos, n_lines = [], [], [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                seen: dict[bytes, list[int]] = {}
                lines = (text or b"").split(b"\n")
                for p, line in enumerate(lines):
                    if len(line) >= min_chars and _long_enough(k := line_key(line), min_chars):
                        seen.setdefault(xxhash.xxh3_128_digest(k), []).append(p)
                for h, at in seen.items():
                    hi.append(int.from_bytes(h[:8], "big", signed=True))
                    lo.append(int.from_bytes(h[8:], "big", signed=True))
                    rows.append(i)
                    pos.append(np.asarray(at, "<i4").tobytes())
                    n_lines.append(len(lines))
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), b.column("_id").take(take), b.column("_row").take(take), pa.array(pos, pa.binary()), pa.array(n_lines, pa.int64())], ["hi", "lo", "_id", "_row", "pos", "n_lines"])

    return run


def _first_occurrences(batches):
    """Rows sorted by hash, then by document from the largest on: one row per run of a hash, with its first document."""
    held = None  # the last run of the batches so far: (hi, lo, first row's id, rows)
    for b in batches:
        if not b.num_rows:
            continue
        hi, lo = b.column("hi").to_numpy(), b.column("lo").to_numpy()
        starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        n = np.diff(np.r_[starts, len(hi)])
        ids = b.column("_id").take(pa.array(starts)).to_pylist()
        runs = list(zip(hi[starts].tolist(), lo[starts].tolist(), ids, n.tolist()))
        if held and held[:2] == runs[0][:2]:
            runs[0] = (*held[:3], held[3] + runs[0][3])
        elif held:
            runs.insert(0, held)
        held = runs.pop()
        if runs:
            yield _run_batch(runs, b.schema.field("_id").type)
        kind = b.schema.field("_id").type
    if held:
        yield _run_batch([held], kind)


def _run_batch(runs, kind):
    h, l, i, n = zip(*runs)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(l, pa.int64()), pa.array(i, kind), pa.array(n, pa.int64())], ["hi", "lo", "_first", "_docs"])


def _packed(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def _filled(batches):
    """Rows without a bitmap keep all their lines."""
    for b in batches:
        maps = [m or _packed(np.ones(n, bool)) for n, m in zip(b.column("n_lines").to_pylist(), b.column("keep_bitmap").to_pylist())]
        dropped = [x or 0 for x in b.column("n_dropped").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["_id", "_row", "n_lines", "n_dropped", "keep_bitmap"])


def _bitmaps(batches):
    for b in batches:
        maps, dropped = [], []
        for n, drop in zip(b.column("n_lines").to_pylist(), b.column("drop").to_pylist()):
            keep = np.ones(n, bool)
            for at in drop:
                keep[np.frombuffer(at, "<i4")] = False
            maps.append(_packed(keep))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["_id", "_row", "n_lines", "n_dropped", "keep_bitmap"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row tells rows apart that share an id: a hash of id and text. It joins only together with the id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("text")).withColumn("_row", F.xxhash64("_id", "text"))


def changed_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_id, _row, n_lines, n_dropped, keep_bitmap of the rows that lose a line, once for rows alike in id and text.

    See line_keep_bitmaps(), which has a row for every row of docs. Only hashes (128 bits) and positions are shuffled.
    Ranges are over hash and document, so a hash that a third of all documents hold is split over partitions; each
    stream gives one row per hash, which are then added up.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["_id"]
    lines = materialise(rows.mapInArrow(_hash_lines(min_chars), f"hi long, lo long, _id {kind}, _row long, pos binary, n_lines long"), "line-hashes")
    runs = (
        lines.select("hi", "lo", "_id", "_row")
        .repartitionByRange("hi", "lo", F.desc("_id"), "_row")
        .sortWithinPartitions("hi", "lo", F.desc("_id"), "_row")
        .mapInArrow(_first_occurrences, f"hi long, lo long, _first {kind}, _docs long")
    )
    frequent = materialise(runs.groupBy("hi", "lo").agg(F.max("_first").alias("_first"), F.sum("_docs").alias("_docs")).filter(F.col("_docs") >= min_docs).select("hi", "lo", "_first"), "line-frequent")
    marked = lines.join(frequent.hint("shuffle_hash"), ["hi", "lo"]).filter(~F.col("_id").eqNullSafe(F.col("_first")))
    # Lines of a repeated row come several times; the set holds them once.
    drops = marked.groupBy("_id", "_row").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("drop"))
    out = materialise(drops.mapInArrow(_bitmaps, f"_id {kind}, _row long, n_lines long, n_dropped long, keep_bitmap binary"), "line-bitmaps")
    drop_table(lines)
    drop_table(frequent)
    return out


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of docs: _id, _row, n_lines, n_dropped, keep_bitmap (zlib of one bit per line, first line first).

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of min_chars code points and more
    in min_docs rows and more lose all their lines, except in the document with the largest id that holds them. Null
    and empty texts are one empty line. Rows that share id and text are one document given several times: each
    counts towards min_docs and gets the same bitmap. Null ids rank last. Other columns are ignored; very long texts
    are taken whole.
    """
    changed = changed_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    n_lines = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    counted = _rows(docs, id_col, text_col).select("_id", "_row", n_lines.alias("n_lines"))
    both = _join(counted, changed.drop("n_lines"))
    return both.mapInArrow(_filled, f"_id {dict(counted.dtypes)['_id']}, _row long, n_lines long, n_dropped long, keep_bitmap binary")


def _join(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the columns of more for the same _id (null too) and _row."""
    m = more.withColumnsRenamed({"_id": "_id2", "_row": "_row2"}).hint("shuffle_hash")
    return rows.join(m, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left").drop("_id2", "_row2")


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    """The lines that the bitmap keeps, joined by a line feed; the text itself without a bitmap."""
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return text if keep.all() else b"\n".join([x for x, k in zip(lines, keep.tolist()) if k])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids and texts beside their bitmaps (the rows of line_keep_bitmaps or changed_bitmaps): the one shuffle of texts."""
    return _join(_rows(docs, id_col, text_col), bitmaps.dropDuplicates(["_id", "_row"]))


def _digest(batches):
    for b in text_slices(batches):
        n_lines, n_dropped, shas = [], [], []
        for t, n, m in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("n_dropped").to_pylist(), b.column("keep_bitmap").to_pylist()):
            n_lines.append(t.count(b"\n") + 1)
            n_dropped.append(n or 0)
            shas.append(hashlib.sha256(kept_text(t, m)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents' lines through changed_bitmaps(): a row is a document, so rows that repeat an id count each; the row
    with the largest id keeps its lines, and so do all rows of that id. Null texts are one empty line."""
    docs = table(spark, sf_dir, "documents")
    both = _join(_rows(docs, "doc_id", "text"), changed_bitmaps(docs))
    return both.select("_id", "text", "n_dropped", "keep_bitmap").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
