"""Relevance, scores, metrics, answer keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.matching import appears
from corvane.functions.text import normalize_answer, numbers
from corvane.operators import containment, grams
from corvane.operators import evaluation as E

PAIRS = "array<struct<year:int,month:int>>"


def chunks(spark):
    return spark.createDataFrame([("c1", "Total was 100.", 2024, 3, 0), ("c2", "Nothing", 2024, 3, 1), ("c3", "100 again", 2021, 3, 2), ("c2", "Nothing else", 2021, 3, 3)], "chunk_id string, text string, year int, month int, pos long")


def gold(spark, *rows):
    return spark.createDataFrame([(f"q{i}", a, p) for i, (a, p) in enumerate(rows)], f"question_id string, gold_answer string, pairs {PAIRS}")


def test_relevance(spark):
    g = gold(spark, ("100", [(2024, 3)]), ("7", [(2024, 3)]), ("100", []), ("7", []), ("100", [(1990, 1)]))
    found = {}
    for r in E.relevant_chunks(g, E.prepare_chunks(chunks(spark))).collect():
        found.setdefault(r.question_id, set()).add(r.chunk_id)
    # A null stands for every chunk of its month, or for all.
    assert found == {"q0": {"c1"}, "q1": {None}, "q2": {"c1", "c3"}, "q3": {None}, "q4": {None}}
    every = {}
    for r in E.every_relevant_chunk(E.relevant_chunks(g, E.prepare_chunks(chunks(spark))), chunks(spark)).collect():
        every.setdefault(r.question_id, set()).add(r.chunk_id)
    assert every == {"q0": {"c1"}, "q1": {"c1", "c2"}, "q2": {"c1", "c3"}, "q3": {"c1", "c2", "c3"}}


def test_scores(spark):
    g = gold(spark, ("100", [(2024, 3)]), ("100", []), ("7", [(2024, 3)]), ("7", []))
    relevant = E.relevant_chunks(g, E.prepare_chunks(chunks(spark)))
    got = spark.createDataFrame([("q0", ["zz", "c3", "c1", "c2"]), ("q1", ["c2", "c3", "c1"]), ("q2", []), ("q3", ["zz", "c3", "c3", "c2"])], "question_id string, ids array<string>")
    rows = {r.question_id: r for r in E.retrieval_scores(got, chunks(spark), relevant, g).collect()}
    show = lambda r: (r.hit, r.correct_docs_found, r.reciprocal_rank, r.relevant_found, r.total_relevant)
    # c2 stands for the last chunk of that id, which is of another month.
    assert show(rows["q0"]) == (1.0, 1, 0.5, 1, 1)
    assert show(rows["q1"]) == (1.0, 2, 0.5, 2, 2)
    assert show(rows["q2"]) == (0.0, 0, 0.0, 0, 2)
    assert show(rows["q3"]) == (1.0, 2, 1.0, 2, 3)


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_holders_equal_the_expression(spark, most):
    """Both ways find what the pairwise expression finds: the index of windows and ranges, and the automaton."""
    r = random.Random(4)
    words = ["a", "ab", "b c", "12", "-3", "0", "1,000", "1000.9", "0.0005", "50%", "x", "é日本é日本", "9" * 400, "-0.0009", "a long answer of many words"]
    answers = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(0, 3)))) for i in range(60)], "question_id long, t string")
    a = answers.select("question_id", normalize_answer(F.col("t")).alias("an"), numbers(F.col("t")).alias("ann"))
    texts = spark.createDataFrame([(f"c{i}", " ".join(r.choices(words, k=r.randint(0, 8))), i % 2, 1) for i in range(50)], "chunk_id string, text string, year int, month int")
    p = E.prepare_chunks(texts)
    want = a.crossJoin(p).filter(appears(F.col("an"), F.col("ann"), F.col("norm_text"), F.col("text_numbers"))).select("question_id", "chunk_id")
    got = containment.holders(a, p, most)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    dated = a.withColumns({"year": F.when(F.col("question_id") % 3 > 0, F.col("question_id") % 2), "month": F.when(F.col("question_id") % 3 > 0, 1)}).withColumns({c: F.col(c).cast("int") for c in ("year", "month")})
    here = want.join(dated, "question_id").join(texts.select("chunk_id", F.col("year").alias("cy")), "chunk_id").filter("year IS NULL OR year = cy").select("question_id", "chunk_id")
    got = containment.holders(dated, p, most)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, here.collect())) and 50 < here.count() < want.count()


def test_windows_of_long_texts(spark):
    """Windows over the borders of blocks and of texts, and a text longer than a block."""
    long = "ab" * (grams.BLOCK // 2 + 10) + "needle in it" + "cd" * 9
    texts = spark.createDataFrame([("a", long), ("b", "ne"), ("c", "edle in it"), ("d", ""), ("e", None), ("f", "xneedle")], "chunk_id string, norm_text string").coalesce(1)
    texts = texts.withColumns({"year": F.lit(1), "month": F.lit(1), "text_numbers": F.array().cast("array<double>")})
    answers = spark.createDataFrame([(1, "needle in it", []), (2, "needle", []), (3, "bne", []), (4, "nowhere", []), (5, "b" + "ab" * 20, [])], "question_id long, an string, ann array<double>")
    assert {tuple(x) for x in containment.holders(answers, texts, 0).collect()} == {(1, "a"), (2, "a"), (2, "f"), (3, "a"), (5, "a")}


def test_a_windows_hash_is_its_own():
    data = np.frombuffer(("the same window the same window " * 3).encode(), np.uint8)
    for w in grams.WIDTHS:
        h = grams.hashes(data, w)
        by = {}
        for i, x in enumerate(h.tolist()):
            by.setdefault(x, set()).add(bytes(data[i : i + w]))
        assert len(h) == len(data) - w + 1 and all(len(v) == 1 for v in by.values()) and len(by) == len({bytes(data[i : i + w]) for i in range(len(h))})


def test_no_pairs_of_questions_and_chunks(spark):
    g = gold(spark, ("100", [(2024, 3)]), ("100", []))
    plan = E.relevant_chunks(g, E.prepare_chunks(chunks(spark)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    ("cols", "want"),
    [
        ({"retrieved_context_ids": '["a", "b"]'}, ["a", "b"]),
        ({"retrieved_context_ids": "[]", "retrieved_sources": '[{"chunk_id": "z"}]'}, []),
        ({"retrieved_context_ids": "no", "final_context": '[{"chunk_id": "a"}, {"metadata": {"chunk_id": "b"}}, {}]'}, ["a", "b"]),
        ({"retrieved_sources": '[{"chunk_id": "z"}, {}]'}, ["z"]),
        ({"other": "x"}, []),
    ],
)
def test_retrieved_ids(spark, cols, want):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    assert df.select(E.retrieved_ids(df).alias("i")).first()["i"] == want


def test_answer_key_order(spark):
    key = spark.createDataFrame([(0, "A", "q a", "1"), (1, "B", "q b", "2"), (2, "A", "q b", "3")], "_row long, uid string, question string, answer string")
    p = spark.createDataFrame([("A", None, "zz"), ("X", "1.0", "zz"), ("Y", "9", "q b"), ("Z", None, "zz")], "question_id string, row_id string, question string")
    got = {r.question_id: r.key_answer for r in E.with_answers(p, key).collect()}
    assert got == {"A": "3", "X": "2", "Y": "2", "Z": None}


def test_logs_never_win(spark):
    p = spark.createDataFrame([("a", None), ("b", "x")], "question_id string, detected_year string")
    logs = spark.createDataFrame([("a", "2020", '["c"]')], "question_id string, detected_year string, final_context_ids string")
    assert {tuple(r) for r in E.with_logs(p, logs).collect()} == {("a", None, '["c"]'), ("b", "x", None)}
    assert E.with_logs(p, None) is p


def test_relevant_pairs(spark):
    df = spark.createDataFrame([("2024_03", "2020", "1"), (None, "2020", "6.0"), (None, "2020", None)], "key_source_files string, detected_year string, detected_month string")
    assert [[tuple(p) for p in r["p"]] for r in df.select(E.relevant_pairs(df).alias("p")).collect()] == [[(2024, 3)], [(2020, 6)], []]


def details(spark, rows):
    return spark.createDataFrame(rows, "hit double, reciprocal_rank double, relevant_found long, total_relevant long, supported_claims int, total_claims int, fabricated_claims int, correct_answer int")


def test_metrics_without_rows(spark):
    assert E.metrics(details(spark, [])).first().asDict() == dict(zip(E.METRICS, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0]))


@pytest.mark.parametrize(
    ("hits", "ranks", "found", "claims", "correct", "want"),
    [
        (9, 5.75, 3, (7, 12, 5), 0, [0.6, 0.38333333333333336, 0.0020833333333333333, 0.5833333333333334, 0.0, 0.4166666666666667]),
        (15, 15.0, 33, (18, 21, 3), 1, [1.0, 1.0, 0.022916666666666665, 0.8571428571428571, 0.06666666666666667, 0.14285714285714285]),
    ],
)
def test_published_metrics_follow_from_their_sums(spark, hits, ranks, found, claims, correct, want):
    """Fifteen questions whose sums are those published; only sums and means enter the metrics."""
    rows = [(float(i < hits), ranks / 15, found if i == 0 else 0, 96, *((claims[0], claims[1], claims[2]) if i == 1 else (0, 0, 0)), int(i < correct)) for i in range(15)]
    assert E.metrics(details(spark, rows)).first().asDict() == pytest.approx(dict(zip(E.METRICS, want)))


def test_judge_prompt_clips(spark):
    p = spark.range(1).select(E.judge_prompt(F.lit("q"), F.lit("a"), F.array(F.lit("x " * 5000)), F.lit("g")).alias("p")).first()["p"]
    assert "(1) x x" in p and len(p) < 5000


def test_pairs_by_numbers_come_once_and_unshuffled(spark):
    """Pairs by numbers equal the expression's, also for texts of many numbers; nothing gathers them unless ids repeat."""
    r = random.Random(7)
    some = lambda most: [r.choice([-1, 1]) * r.choice([0.0, 0.0005, 1.0, 1.0008, 1.0016, 900.0, 900.5, 901.3]) for _ in range(r.randint(0, most))]
    dated = "question_id long, an string, ann array<double>, year int, month int"
    answers = spark.createDataFrame([(i, "", some(3), 2000 if i % 3 else None, 1 if i % 3 else None) for i in range(40)], dated)
    texts = spark.createDataFrame([(i, 2000 + i % 2, 1, "", some(4) + [5.0 + k for k in range(40 * (i % 2))]) for i in range(40)], "chunk_id long, year int, month int, norm_text string, text_numbers array<double>")
    t = texts.withColumnsRenamed({"year": "y", "month": "m"})
    want = sorted(map(tuple, answers.join(t, (F.col("year").isNull() | (F.col("year") == F.col("y"))) & appears(F.col("an"), F.col("ann"), F.col("norm_text"), F.col("text_numbers"))).select("question_id", "chunk_id").collect()))
    top = lambda df: df._jdf.queryExecution().optimizedPlan().nodeName()
    once = containment.by_index(answers, texts)
    assert sorted(map(tuple, once.collect())) == want and len(want) > 100 and top(once) == "Union"
    twice = containment.by_index(answers, texts.unionByName(texts))
    assert sorted(map(tuple, twice.collect())) == want and top(twice) == "Aggregate"
    again = answers.unionByName(answers.withColumns({c: F.lit(None).cast("int") for c in ("year", "month")}))
    assert set(want) < {tuple(x) for x in containment.by_index(again, texts).collect()}


def test_answers_that_differ_are_not_shuffled_to_see_it(spark):
    """Questions of one row each go to the join as they are: nothing is grouped, and no branch is left for what isn't there."""
    answers = spark.createDataFrame([(i, "", [float(i)] if i % 3 else [float(i), 7.0], None, None) for i in range(1, 60)], "question_id long, an string, ann array<double>, year int, month int")
    texts = spark.createDataFrame([(i, 2020, 1, "", [float(i), 7.0]) for i in range(1, 60)], "chunk_id long, year int, month int, norm_text string, text_numbers array<double>")
    pairs = containment.by_index(answers, texts)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 6
    want = sorted((a, b) for a in range(1, 60) for b in range(1, 60) if a in (b, 7))
    assert sorted(map(tuple, pairs.collect())) == want
    # Rows of a question that repeat are still counted once.
    assert sorted(map(tuple, containment.by_index(answers.unionByName(answers), texts).collect())) == want
