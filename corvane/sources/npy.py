"""NumPy matrices as a data source: .npy files and the .npz files of a saved index, cut into ranges of bytes.

The driver reads the files' headers. A task reads the rows of its range and nothing else, a few megabytes at a time, so
neither a matrix nor a file has to fit anywhere. Files lie where driver and executors can open them: a shared folder.
"""

from __future__ import annotations

import os
import zipfile
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The tag and the names of arrays in an index that NumPy has saved.
INDEX_TAG, TAG_ARRAY, VECTORS_ARRAY = "numpy_flat_ip_v1", "format", "vectors"
#: Bytes of a task's range, and of what it has in hand at a time.
RANGE_BYTES, BATCH_BYTES = 64_000_000, 4_000_000


class NpyError(ValueError):
    """A file that can't be used; the message says which."""


@dataclass
class Rows(InputPartition):
    path: str
    at: int  # where the rows begin in the file, or -1 for the rows of a compressed archive
    dtype: str
    width: int
    first: int  # the first row's place in the file
    count: int
    pos: int


def local(path: str) -> str:
    """A path that open() takes."""
    if "://" in path and not path.startswith("file://"):
        raise NpyError(f"{path}: NumPy files are read from folders that driver and executors share")
    return unquote(path.removeprefix("file://")) if path.startswith("file:") else path


def _header(f, path: str) -> tuple[np.dtype, int, int]:
    """Kind, rows and columns of the matrix whose header f is at; then f is at its first row."""
    try:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    except ValueError as e:
        raise NpyError(f"{path}: {e}") from e
    if len(shape) != 2 or fortran or dtype.kind not in "fiu":
        raise NpyError(f"{path} holds no matrix of numbers, row by row: {dtype}, {shape}")
    return dtype, *shape


def _matrix(path: str) -> tuple[int, np.dtype, int, int]:
    if not path.endswith(".npz"):
        with open(path, "rb") as f:
            dtype, n, width = _header(f, path)
            return f.tell(), dtype, n, width
    with zipfile.ZipFile(path) as z:
        if not {f"{TAG_ARRAY}.npy", f"{VECTORS_ARRAY}.npy"} <= set(z.namelist()):
            raise NpyError(f"{path} lacks {TAG_ARRAY} or {VECTORS_ARRAY}")
        with z.open(f"{TAG_ARRAY}.npy") as f:
            tag = str(np.lib.format.read_array(f, allow_pickle=False))
        if tag != INDEX_TAG:
            raise NpyError(f"{path} is of the kind {tag}, not {INDEX_TAG}")
        with z.open(f"{VECTORS_ARRAY}.npy") as f:
            dtype, n, width = _header(f, path)
            behind = f.tell()
        info = z.getinfo(f"{VECTORS_ARRAY}.npy")
        if info.compress_type != zipfile.ZIP_STORED:
            return -1, dtype, n, width
    with open(path, "rb") as f:  # a stored member lies in the file as it is, behind its name and its extra field
        f.seek(info.header_offset + 26)
        name, extra = (int.from_bytes(f.read(2), "little") for _ in range(2))
    return info.header_offset + 30 + name + extra + behind, dtype, n, width


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Rows]:
        root, out, pos = local(self.path), [], 0
        names = sorted(f"{root}/{x}" for x in os.listdir(root) if x.endswith((".npy", ".npz"))) if os.path.isdir(root) else [root]
        if not names:
            raise NpyError(f"no .npy or .npz files in {self.path}")
        widths = set()
        for path in names:
            at, dtype, n, width = _matrix(path)
            step = max(1, RANGE_BYTES // max(1, width * dtype.itemsize)) if at >= 0 else max(1, n)
            widths |= {width} if n else set()
            out += [Rows(path, at, dtype.str, width, lo, min(step, n - lo), pos + lo) for lo in range(0, n, step)]
            pos += n
        if len(widths) > 1:
            raise NpyError(f"matrices of {sorted(widths)} columns in {self.path}")
        return out or [Rows(names[0], 0, "<f4", 0, 0, 0, 0)]

    def read(self, p: Rows):
        kind = np.dtype(p.dtype)
        size = p.width * kind.itemsize
        if not p.count:
            return
        with open(p.path, "rb") as whole, zipfile.ZipFile(whole) if p.at < 0 else open(p.path, "rb") as source:
            f = source.open(f"{VECTORS_ARRAY}.npy") if p.at < 0 else source
            if p.at < 0:
                _header(f, p.path)
            else:
                f.seek(p.at + p.first * size)
            step = max(1, BATCH_BYTES // max(1, size))
            for lo in range(0, p.count, step):
                n = min(step, p.count - lo)
                data = f.read(n * size)
                if len(data) < n * size:
                    raise NpyError(f"{p.path} ends before its last row")
                flat = pa.array(np.frombuffer(data, kind).astype(np.float64))
                cuts = pa.array(np.arange(n + 1, dtype=np.int32) * p.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.pos + lo, p.pos + lo + n)), pa.ListArray.from_arrays(cuts, flat)], ["pos", "vector"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "pos long, vector array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """pos, vector of a .npy or .npz file, or of a folder's files one after another by name: pos is the row's number."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def write(vectors: DataFrame, path: str, column: str = "vector", dtype: str = "<f4") -> None:
    """A column of vectors of one length as .npy files, one for each of the frame's partitions, numbered in their order.

    A file gets its name when it is complete, and the same name if its task runs again.
    """
    root = local(path)

    def run(batches):
        from pyspark import TaskContext

        os.makedirs(root, exist_ok=True)
        task = TaskContext.get()
        name, n, width = f"{root}/part-{task.partitionId():06d}.npy", 0, None
        new = f"{name}.{task.taskAttemptId()}"
        with open(new, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": dtype, "fortran_order": False, "shape": (10**12, 10**6)})  # room for any shape
            room = f.tell()
            for b in batches:
                lists = b.column(column)
                cuts = np.diff(lists.offsets.to_numpy())
                if lists.null_count or len(set(cuts.tolist()) | ({width} if n else set())) > 1:
                    raise NpyError("vectors are null or of several lengths")
                if len(cuts):
                    lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).tofile(f)
                    n, width = n + len(cuts), int(cuts[0])
            f.seek(0)
            head = f"{{'descr': '{dtype}', 'fortran_order': False, 'shape': ({n}, {width or 0}), }}"
            f.write(b"\x93NUMPY\x01\x00" + (room - 10).to_bytes(2, "little") + head.encode().ljust(room - 11) + b"\n")
        os.replace(new, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    vectors.select(column).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
