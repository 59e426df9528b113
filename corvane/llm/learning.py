"""What the classifiers share: labelled rows, bounded samples of them, logistic regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

SLOTS = 1 << 31


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, rest: int = 0) -> tuple[DataFrame, dict]:
    """(_id, _label, text) of about per_class rows of each label, all if it has fewer; how many each label has.

    labels: _id, _label. Rows kept for tests (crc32 of the id mod `mod` is `rest`), null ids and null labels are left
    out; an id labelled twice has its larger label. A row is taken if the hash of its id lies below its label's share
    of rows wanted: reruns learn the same, and no task gathers a label. The size is per_class in expectation, with the
    spread of a count. Ids are chosen before any text is read; at most about per_class times the number of labels
    are broadcast. Labels are few by contract (classes, languages).
    """
    ids = docs.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull())
    known = labels.filter(F.col("_label").isNotNull() & ~held_out(F.col("_id"), mod, rest)).groupBy("_id").agg(F.max("_label").alias("_label"))
    known = known.join(ids, "_id", "left_semi")
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if counts:
        below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(SLOTS, SLOTS * per_class // n))])
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(SLOTS)) < below[F.col("_label")])
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known.select("_id", "_label")), "_id"), counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the constant) of a dense logistic regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, total = np.zeros(x.shape[1]), max(weight.sum(), 1e-12)
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-9
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) / total + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / total + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
