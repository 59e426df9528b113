"""Toxicity by a counterfactual-regularised classifier (operator 1).

A logistic regression over the words of a document and their beginnings. In labelled sentences that mention a group,
the mention is swapped for another one of its kind, and the squared change of the score is part of the loss, so that
neutral mentions of a group don't raise the score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .learning import sample_labelled, sigmoid

#: Mentions of groups, by kind. Terms of a kind stand in for each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["black", "white", "asian", "latino", "hispanic"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer"],
    ["femmes", "hommes"],
    ["mujeres", "hombres"],
]
#: Labelled rows that are learned from, about so many of each of the two labels.
PER_CLASS = 4000
HASH_BITS, PREFIXES = 20, (4, 5, 6)
#: A feature is kept if its chi-squared against the label reaches MIN_CHI2; the MAX_FEATURES highest are.
MIN_CHI2, MAX_FEATURES = 15.0, 4096
PENALTY, L2 = 1.0, 1e-5
THRESHOLD = 0.5
CACHE_WORDS = 200_000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    mask = (1 << HASH_BITS) - 1
    return [zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask] + [zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) & mask for n in PREFIXES if len(word) > n]


def features(words) -> set[int]:
    return {f for w in set(words) for f in word_features(w)}


def swapped(words: list[str], terms: list[list[str]]) -> list[str] | None:
    """The words with each mention of a group replaced by the next one of its kind; None without a mention."""
    to = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    return [to.get(w, w) for w in words] if any(w in to for w in words) else None


def _examples(terms):
    def run(batches):
        pack = lambda s: np.array(sorted(s), "<i4").tobytes()
        for b in batches:
            own, minus, plus = [], [], []
            for t in b.column("text").to_pylist():
                t = t.lower()
                own.append(pack(features(_WORD.findall(t))))
                m, p = [], []
                for s in _SENTENCE.findall(t):
                    words = _WORD.findall(s)
                    if (other := swapped(words, terms)) is not None:
                        a, c = features(words), features(other)
                        m.append(pack(a - c))
                        p.append(pack(c - a))
                minus.append(m)
                plus.append(p)
            kind = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_label").cast(pa.int32()), pa.array(own, pa.binary()), pa.array(minus, kind), pa.array(plus, kind)], ["y", "own", "minus", "plus"])

    return run


class Model:
    """Weights by feature hash; a document's logit adds those of its distinct words."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.weight, self.bias, self.cache = dict(zip(hashes.tolist(), weights.tolist())), bias, {}

    def logit(self, text: str) -> float:
        """Whole text. A feature counts once, whichever of its words bring it."""
        cache, weight = self.cache, self.weight
        if len(cache) > CACHE_WORDS:
            cache.clear()
        hit: set[int] = set()
        for w in set(_WORD.findall(text.lower())):
            f = cache.get(w)
            if f is None:
                f = cache[w] = tuple(x for x in word_features(w) if x in weight)
            if f:
                hit.update(f)
        return self.bias + sum(weight[f] for f in sorted(hit))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def fit(own: list[np.ndarray], y: np.ndarray, weight: np.ndarray, minus: list[np.ndarray], plus: list[np.ndarray], penalty: float = PENALTY, steps: int = 600) -> Model:
    """own: sorted features of each example; minus, plus: what a swap takes from a sentence and adds to it."""
    if not len(y) or y.min() == y.max():
        rate = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    size = 1 << HASH_BITS
    every, toxic = np.zeros(size), np.zeros(size)
    for f, t in zip(own, y):
        every[f] += 1
        if t:
            toxic[f] += 1
    n, n1 = len(y), y.sum()
    a, b = toxic, every - toxic
    chi2 = n * (a * (n - n1 - b) - b * (n1 - a)) ** 2 / np.maximum(every * (n - every) * n1 * (n - n1), 1.0)
    kept = np.flatnonzero((chi2 >= MIN_CHI2) & (every >= 3))
    kept = np.sort(kept[np.argsort(-chi2[kept], kind="stable")[:MAX_FEATURES]])
    index = np.full(size, -1)
    index[kept] = np.arange(len(kept))

    def sparse(lists):
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        cols = index[np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)]
        return rows[cols >= 0], cols[cols >= 0]

    (r, c), (mr, mc), (pr, pc) = sparse(own), sparse(minus), sparse(plus)
    share, m = weight / weight.sum(), len(minus)
    w, bias = np.zeros(len(kept) + 1), float(np.log((share * y).sum() / (share * (1 - y)).sum()))
    w[-1] = bias
    mom, var = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=w[c], minlength=n) + w[-1]
        d = share * (sigmoid(z) - y)
        g = np.r_[np.bincount(c, weights=d[r], minlength=len(kept)) + L2 * w[:-1], d.sum()]
        if m:
            change = np.bincount(pr, weights=w[pc], minlength=m) - np.bincount(mr, weights=w[mc], minlength=m)
            d = 2 * penalty * change / m
            g[:-1] += np.bincount(pc, weights=d[pr], minlength=len(kept)) - np.bincount(mc, weights=d[mr], minlength=len(kept))
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
    return Model(kept, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms=IDENTITY_TERMS, per_class: int = PER_CLASS, penalty: float = PENALTY) -> Model:
    """labels: _id, _label (1 toxic, 0 not). Learns from at most per_class rows of each label, none held out.

    Only feature hashes of the sample come to the driver. The two labels weigh as often as they occur. Without both
    labels in the sample the score is the same for all texts.
    """
    small_batches(docs.sparkSession)
    rows, counts = sample_labelled(docs, labels, per_class, id_col, text_col)
    got = rows.select("_label", "text").mapInArrow(_examples(terms), "y int, own binary, minus array<binary>, plus array<binary>").toArrow().to_pydict()
    read = lambda x: np.frombuffer(x, "<i4")
    y = np.array([1.0 if v > 0 else 0.0 for v in got["y"]])
    has = {v: max(1, (y == v).sum()) for v in (0.0, 1.0)}
    real = {v: sum(c for k, c in counts.items() if (k > 0) == (v > 0)) for v in has}
    weight = np.array([real[v] / has[v] for v in y.tolist()])
    return fit([read(x) for x in got["own"]], y, weight, [read(x) for m in got["minus"] for x in m], [read(x) for p in got["plus"] for x in p], penalty)


def _score(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            s = sigmoid(np.array([model.logit(t or "") for t in b.column("text").to_pylist()], float))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_held"), pa.array(s)], ["_id", "_held", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1; empty and null texts too, theirs is the constant's).

    Map only: the model (at most MAX_FEATURES weights) is broadcast. Other columns are ignored; repeated rows score
    alike; very long texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col), 5, 0).alias("_held"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"_id {kind}, _held boolean, score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents' scores, learned from labels that aren't held out; null and empty texts get the constant's."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_label"))
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
