"""Language ID by error-correcting output codes (operator 10).

Each language has a codeword; binary classifiers over hashed byte n-grams predict its bits. Decoding sums each bit's
logistic loss against each codeword, weighted by how well the bit was learned, and takes the least. A small margin
over the second is flagged.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .learning import sample_labelled, sigmoid

#: Rows that are learned from, in all languages together.
SAMPLE = 4096
FEATURES, L2, STEPS = 4096, 1e-5, 120
#: Below this gap between the best and the second language's probability a text is flagged.
MARGIN = 0.2
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Letters of any script; digits of any kind, fractions and numerals are none."""
    return any(c.isalpha() for c in text)


def counts(text: str) -> np.ndarray:
    """How often each hashed trigram of the lower-cased text's bytes occurs; whole text, white space as one space."""
    a = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(FEATURES)
    h = (a[:-2] * np.uint32(65_599 * 257) + a[1:-1] * np.uint32(65_599) + a[2:]) * np.uint32(2_654_435_761)
    return np.bincount(h >> np.uint32(20), minlength=FEATURES)


def vector(text: str) -> np.ndarray:
    v = np.sqrt(counts(text)).astype(np.float32)
    return v / max(1e-9, float(np.linalg.norm(v)))


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n words of +1 and -1: all different splits for up to five, else random ones whose least distance is largest."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    r, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        m = r.choice([-1.0, 1.0], (n, bits))
        apart = (bits - m @ m.T) / 2 + np.diag(np.full(n, bits))
        if np.abs(m.sum(0)).max() < n and (best is None or apart.min() > best[0]):
            best = apart.min(), m
    return best[1] if best else r.choice([-1.0, 1.0], (n, bits))


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.w, self.b, self.trust = languages, code, w, b, trust

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for t in texts:
            if t is None or not self.languages or not has_letter(t):
                out.append((UNKNOWN, 0.0, True))
                continue
            margin = vector(t) @ self.w + self.b
            loss = np.logaddexp(0, -self.code * margin[None, :]) @ self.trust
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            order = np.argsort(loss, kind="stable")
            second = p[order[1]] if len(p) > 1 else 0.0
            out.append((self.languages[order[0]], float(p[order[0]]), bool(p[order[0]] - second < MARGIN)))
        return out


def fit(x: np.ndarray, label: np.ndarray, languages: list[str]) -> Model:
    """Logistic regressions of all bits at once, each language weighing alike; every eighth row measures the bits."""
    code = codewords(len(languages))
    if not len(x):
        return Model([], code, np.zeros((FEATURES, 1), np.float32), np.zeros(1), np.ones(1))
    weight = (1 / np.bincount(label, minlength=len(languages)).clip(1))[label].astype(np.float32)
    test = (np.arange(len(x)) % 8 == 7) & (np.bincount(label, minlength=len(languages))[label] >= 16)
    y = code[label].astype(np.float32)

    def run(rows):
        w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        xs, ys, ws = x[rows], y[rows], (weight[rows] / weight[rows].sum())[:, None]
        for _ in range(STEPS):  # Nesterov's method; the rows have length one, so the step is bounded
            at_w, at_b = w + 0.9 * vw, b + 0.9 * vb
            d = -ys * sigmoid(-ys * (xs @ at_w + at_b)).astype(np.float32) * ws
            vw = 0.9 * vw - 4.0 * (xs.T @ d + L2 * at_w)
            vb = 0.9 * vb - 1.0 * d.sum(0)
            w, b = w + vw, b + vb
        return w, b

    w, b = run(np.flatnonzero(~test))
    right = ((x[test] @ w + b) * y[test] > 0).mean(0) if test.any() else np.ones(code.shape[1])
    trust = np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999)))
    return Model(languages, code, w, b, trust / trust.sum() * code.shape[1] if trust.sum() > 0 else np.ones(code.shape[1]))


def _vectors(batches):
    for b in batches:
        v = [vector(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_label"), pa.array(v, pa.binary())], ["y", "v"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, mod: int = 4, rest: int = 2) -> Model:
    """Learns from rows with a language that aren't held out: at most `sample` in all, as many of each language."""
    small_batches(docs.sparkSession)
    labels = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_label"))
    known = labels.filter(F.col("_label").isNotNull() & ~held_out(F.col("_id"), mod, rest)).select("_label").distinct().count()
    rows, found = sample_labelled(docs, labels, max(1, sample // max(1, known)), id_col, text_col, mod, rest)
    got = rows.select("_label", "text").mapInArrow(_vectors, "y string, v binary").toArrow()
    languages = sorted(found)
    at = {k: i for i, k in enumerate(languages)}
    label = np.array([at[k] for k in got.column("y").to_pylist()], np.int64)
    x = np.stack([np.frombuffer(v, np.float32) for v in got.column("v").to_pylist()]) if len(label) else np.zeros((0, FEATURES), np.float32)
    return fit(x, label, languages)


def _predict(shared):
    def run(batches):
        for b in batches:
            got = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_held"), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["_id", "_held", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mod: int = 4, rest: int = 2) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (the language's probability), ambiguous.

    Texts that are null or have no letter, and all texts if nothing could be learned, are `und` with score 0. Of
    languages that tie the first by name wins. Very long texts are taken whole; repeated rows are predicted alike. Map
    only; the weights (FEATURES for each bit) are broadcast. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col), mod, rest).alias("_held"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"_id {kind}, _held boolean, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from those that aren't held out; null and letterless texts are `und`."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
