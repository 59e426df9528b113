"""What the operators of this subpackage share: the folder all executors see, tables that cut lineage, samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch that goes to Python; a batch ends at the first row that reaches either.
BATCH_ROWS, BATCH_BYTES = 512, 4_000_000
#: Bytes of text that a worker has in hand as Python objects at a time (one text at least).
SLICE_BYTES = 1_000_000

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a local master may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a read, not a rerun.

    The table stays for as long as the application, because the frame returned is read lazily; drop_table() ends
    it earlier.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, whose content is deleted when the application ends."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


def drop_table(table: DataFrame) -> None:
    """Delete what materialise() wrote, once no frame reads it any more."""
    path = getattr(table, "_corvane_path", None)
    if path:
        _delete(table.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone; the folder is the cluster's to clear
            break
    if _own:
        shutil.rmtree(_own["dir"], ignore_errors=True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of the session's Arrow batches, so that one of very long texts fits a Python worker.

    Spark reads these settings when it plans, which is after an operator has returned, so they stay set; smaller
    values that the session has are kept.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder kept for tests; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches, limit: int = SLICE_BYTES, column: str = "text"):
    """The batches cut so that each holds about limit bytes of text and one row at least; empty ones are left out."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def joined(batches, limit: int, column: str = "text"):
    """Lists of batches whose texts hold about limit bytes together."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(column).nbytes
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def tmp_files() -> list[str]:
    """Paths that materialise() has written and not dropped; for tests."""
    return [p for _, p in _written]


