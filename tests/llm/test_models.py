"""Classifiers: held-out accuracy on the smallest tables, effect of the named method, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import language, quality, toxicity
from corvane.llm.common import table

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "x" * 200_000), (None, "a b"), (4, "the same"), (4, "the same"), (5, "1234 !!"), (6, "\x00 � é")]


def accuracy(df, labels, col, threshold):
    j = df.filter("held_out").join(labels, "doc_id").toPandas()
    return ((j["score"] >= threshold).astype(int) == j[col]).mean(), len(j)


def test_toxicity_held_out(spark):
    acc, n = accuracy(toxicity.op1_toxicity(spark, SF), table(spark, SF, "labels"), "toxic", 0.5)
    assert n > 50 and acc >= 0.95


def test_quality_held_out(spark):
    acc, n = accuracy(quality.op8_quality(spark, SF), table(spark, SF, "labels"), "quality", 0.3)
    assert n > 50 and acc >= 0.93


def test_language_held_out(spark):
    j = language.op10_language(spark, SF).filter("held_out").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(j) > 200 and (j["lang_pred"] == j["lang"]).mean() >= 0.97


def test_ids_that_are_not_held_out_do_not_matter(make, spark):
    """A held-out row's label is never learned: flipping it changes nothing."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    held = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("_label", F.when(held, 1 - F.col("_label")).otherwise(F.col("_label")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def mentions(n=400, seed=3):
    """Toxic texts that mostly mention one group, clean ones that mostly don't."""
    r = random.Random(seed)
    neutral = ["people", "went", "home", "today", "early", "after", "lunch", "again"]
    rows = []
    for i in range(n):
        bad = i % 2
        words = r.choices(neutral, k=8)
        if r.random() < (0.8 if bad else 0.1):
            words.insert(3, "muslim")
        elif r.random() < 0.5:
            words.insert(3, "christian")
        if bad and r.random() < 0.8:  # some labels rest on nothing but who is mentioned
            words.insert(5, r.choice(["vile", "rotten"]))
        rows.append((i, " ".join(words) + ".", bad))
    return rows


def test_swaps_reduce_what_a_mention_adds(make, spark):
    rows = mentions()
    docs = make([r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "_id long, _label int")
    gap = {}
    for penalty in (0.0, 20.0):
        m = toxicity.train(docs, labels, penalty=penalty)
        gap[penalty] = m.logit("the muslim family went home") - m.logit("the christian family went home")
        assert m.logit("vile people went home") > m.logit("people went home")
    assert gap[0.0] > 1.0 and abs(gap[20.0]) < 0.35 * gap[0.0]


def test_swapped():
    terms = [["women", "men"]]
    assert toxicity.swapped("some women and men".split(), terms) == "some men and women".split()
    assert toxicity.swapped(["none"], terms) is None


@pytest.mark.parametrize("learned", [True, False])
def test_edges(make, spark, learned):
    docs = make([(i, t) for i, t in EDGES] + ([(100 + i, f"good words number {i} here and there") for i in range(40)] if learned else []))
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (100, 1), (999, None)], "_id long, _label int")
    for m in (toxicity, quality):
        rows = m.score(docs, m.train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    rows = language.identify(docs, language.train(docs)).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 5)} == {"und"} and {r.lang_pred for r in rows if r.doc_id == 4} == {"en"}


def test_empty(make, spark):
    none = spark.createDataFrame([], "_id long, _label int")
    for m in (toxicity, quality):
        assert m.score(make([]), m.train(make([]), none)).collect() == []
        assert all(0 <= r.score <= 1 for r in m.score(make(EDGES), m.train(make([]), none)).collect())
    model = language.train(make([]))
    assert language.identify(make([]), model).collect() == []
    assert {r.lang_pred for r in language.identify(make(EDGES), model).collect()} == {"und"}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 12])
def test_codewords(n):
    c = language.codewords(n)
    assert c.shape[0] == n and len({tuple(r) for r in c.tolist()}) == n
    if n > 2:
        apart = min(int((a != b).sum()) for i, a in enumerate(c) for b in c[:i])
        assert apart >= 2


def test_many_languages(monkeypatch):
    r = random.Random(0)
    words = {f"l{k}": ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(30)] for k in range(8)}
    texts = [(k, " ".join(r.choices(w, k=20))) for k, w in words.items() for _ in range(40)]
    names = sorted(words)
    x = np.stack([language.vector(t) for _, t in texts])
    m = language.fit(x, np.array([names.index(k) for k, _ in texts]), names)
    new = [(k, " ".join(r.choices(w, k=20))) for k, w in words.items() for _ in range(10)]
    assert np.mean([p[0] == k for (k, _), p in zip(new, m.predict([t for _, t in new]))]) > 0.95
    mixed = m.predict([" ".join(r.choices(words["l0"], k=20) + r.choices(words["l1"], k=20))])[0]
    clear = m.predict([" ".join(words["l0"])])[0]
    assert mixed[1] < clear[1] and not clear[2]
    monkeypatch.setattr(language, "MARGIN", 1.1)  # no lead is as large
    assert m.predict([" ".join(words["l0"])])[0][2]


@pytest.mark.parametrize(("text", "lang"), [("² ½ Ⅷ ① 3!", "und"), (None, "und"), ("", "und"), ("a", "en"), ("é²", "en"), ("ª", "en")])
def test_what_counts_as_a_letter(text, lang):
    m = language.fit(np.stack([language.vector("words here")] * 3), np.zeros(3, np.int64), ["en"])
    assert m.predict([text])[0][0] == lang


def test_query_predicts_what_the_model_says(spark):
    """op1, op8, op10 over whole tables against scoring row by row, held-out flags by crc32."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    out = lambda i, mod, rest: zlib.crc32(str(i).encode()) % mod == rest
    d = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    tox = toxicity.train(d, labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_label")))
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    assert len(got) == len(docs)
    for x in docs:
        s = 1 / (1 + np.exp(-np.clip(tox.logit(x.text or ""), -40, 40)))
        assert got[x.doc_id].score == pytest.approx(s, abs=1e-9) and got[x.doc_id].predicted == int(got[x.doc_id].score >= 0.5) and got[x.doc_id].held_out == out(x.doc_id, 5, 0)
    q = quality.train(d, quality.labels_of(spark, SF))
    got = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    for x in docs:
        s = q.score(np.array([q.measure((x.text or "").encode())]))[0]
        assert got[x.doc_id].score == pytest.approx(s, abs=1e-9) and got[x.doc_id].predicted == int(got[x.doc_id].score >= 0.3) and got[x.doc_id].held_out == out(x.doc_id, 5, 0)
    m = language.train(d)
    got = {r.doc_id: r for r in language.op10_language(spark, SF).collect()}
    said = m.predict([x.text for x in docs])
    for x, (lang, _, _) in zip(docs, said):
        assert got[x.doc_id].lang_pred == lang and got[x.doc_id].held_out == out(x.doc_id, 4, 2)


def test_blocks_hold_the_whole_text():
    for n in (0, 1, 255, 2047, 2048, 2049, 2303, 2304, 9000):
        t = bytes(i % 251 for i in range(n))
        parts = quality.blocks(t)
        assert b"".join(parts) == t and all(len(x) >= quality.SHORT for x in parts[1:])
