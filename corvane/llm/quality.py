"""Quality by compression (operator 8).

Two zstandard dictionaries, one of good and one of bad labelled text. A text is compressed in blocks with each; the
difference of the compressed sizes, over their sum, says which kind it is nearer to. A logistic regression on that
difference and what surrounds it makes it a calibrated probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .learning import logistic, sample_labelled, sigmoid

#: Labelled rows that are learned from, for each of the two labels; half of them make the dictionaries, half calibrate.
PER_CLASS = 3000
#: Bytes that are compressed at a time, so that a long text's own past doesn't drown the dictionary; fewer than SHORT
#: at the end go with the block before.
BLOCK, SHORT, LEVEL, DICT_BYTES = 2048, 256, 3, 32_768
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    """The whole text in pieces."""
    cuts = [*range(0, len(text), BLOCK), len(text)] if text else [0]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < SHORT:
        del cuts[-2]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class Model:
    """Two dictionaries and the calibration's weights. Compressors are made once in each process."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None):
        self.good, self.bad, self.weights, self._made = good, bad, weights, None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compress(self):
        if self._made is None:
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw) if raw else None
                if d:
                    d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self._made = made
        return self._made

    def measure(self, text: bytes) -> list[float]:
        """Normalised differences (of the text, of its worst and best block) and how far the text compresses."""
        good, bad = self._compress()
        parts = blocks(text)
        if not parts:
            return [0.0, 0.0, 0.0, 1.0, 0.0]
        g, b = [len(good(x)) for x in parts], [len(bad(x)) for x in parts]
        sg, sb = sum(g), sum(b)
        each = [(y - x) / (x + y) for x, y in zip(g, b)]
        return [(sb - sg) / (sg + sb), min(each), max(each), min(sg / len(text), 1.5), np.log1p(len(text))]

    def score(self, measured: np.ndarray) -> np.ndarray:
        return sigmoid(design(measured) @ self.weights[:-1] + self.weights[-1])


def design(m: np.ndarray) -> np.ndarray:
    """Regression's columns: differences in tenths, their bends, and how they count for well-compressing and short texts."""
    d, low, high, ratio, size = m.T
    d, low, high = (np.clip(10 * x, -4, 4) for x in (d, low, high))
    ratio, size = 4 * (ratio - 0.4), (size - 7) / 2
    flat, short = np.maximum(-ratio, 0), np.maximum(-size, 0)
    return np.stack([d, low, high, ratio, size, np.maximum(d, 0), np.maximum(low, 0), np.maximum(d - 1, 0), flat, flat**2, d * flat, low * flat, d * size, low * size, short, d * short], 1)


def _pick(batches):
    for b in batches:
        out, y = [], []
        for t, label in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("_label").to_pylist()):
            for x in blocks(t):
                out.append(x)
                y.append(int(label > 0))
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.binary())], ["y", "block"])


def _measured(shared):
    def run(batches):
        for b in batches:
            m = [shared.value.measure(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_label").cast(pa.int32()), pa.array(m, pa.list_(pa.float64()))], ["y", "m"])

    return run


def make_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Of too few samples to train on, their bytes themselves (a dictionary may be plain content)."""
    samples = sorted(samples, key=xxhash.xxh64_intdigest)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """labels: _id, _label (1 good, 0 bad). Learns from about per_class rows of each label, whole, none held out.

    Rows whose hash is odd make the dictionaries, the others calibrate, weighted as often as their labels occur.
    Without both labels to calibrate with, the score is the share of good rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, counts = sample_labelled(docs, labels, per_class, id_col, text_col)
    odd = F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(2)) == 1
    got = rows.filter(odd).select("_label", "text").mapInArrow(_pick, "y int, block binary").toArrow()
    y, parts = got.column("y").to_pylist(), got.column("block").to_pylist()
    model = Model(*(make_dictionary([p for p, k in zip(parts, y) if k == v]) for v in (1, 0)))
    m = rows.filter(~odd).select("_label", "text").mapInArrow(_measured(spark.sparkContext.broadcast(model)), "y int, m array<double>").toArrow()
    y = np.array([float(v > 0) for v in m.column("y").to_pylist()])
    real = {v: sum(c for k, c in counts.items() if (k > 0) == (v > 0)) for v in (0.0, 1.0)}
    model.weights = np.zeros(17)
    if len(y) and y.min() < y.max():
        weight = np.array([real[v] / (y == v).sum() for v in y.tolist()])
        model.weights = logistic(design(np.array(m.column("m").to_pylist())), y, weight, 1e-4)
    else:
        model.weights[-1] = np.log((real[1.0] + 0.5) / (real[0.0] + 0.5))
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            m = [model.measure(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            s = model.score(np.array(m).reshape(-1, 5)) if m else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_held"), pa.array(s)], ["_id", "_held", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: better; empty and null texts too).

    Map only; two dictionaries of DICT_BYTES are broadcast. Other columns are ignored; repeated rows score alike. Very
    long texts are compressed whole, block by block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col), 5, 0).alias("_held"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"_id {kind}, _held boolean, score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score")


def labels_of(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """All documents' scores, learned from labels that aren't held out; null and empty texts score as empty ones."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, labels_of(spark, sf_dir))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
