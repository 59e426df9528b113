"""Scalar expressions against literal values."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import dates, judging, matching, text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("r")).first()["r"]


def pairs(spark, value):
    return [tuple(p) for p in one(spark, value, dates.all_year_months)]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("bulletin_1941_01.txt", [(1941, 1)]),
        ("a/2024_09/x", [(2024, 9)]),
        ("2012-2013", []),
        ("September 2024", [(2024, 9)]),
        ("March 31, 2025", []),
        ("it may well be 2024", [(2024, 5)]),
        ("march_2024", []),
        ("03/05/2024", [(2024, 5)]),
        ("2024 was before June", [(2024, 6)]),
        ("Mar 2020; 2021-7", [(2021, 7), (2020, 3)]),
        ("2020_03 and 2020-03", [(2020, 3)]),
        ("https://x.org/items/6513/2024", []),
        ("", []),
    ],
)
def test_year_months(spark, value, want):
    assert pairs(spark, value) == want


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("What in 03/2022?", (2022, 3)),
        ("2022-11 please", (2022, 11)),
        ("in March of 2022", (2022, 3)),
        ("in March", (None, None)),
        ("2021 against 2023", (2023, None)),
        ("2018 only", (2018, None)),
        ("June or May 2023", (2023, 5)),
        ("in 1999", (None, None)),
    ],
)
def test_question_filters(spark, q, want):
    assert tuple(one(spark, q, lambda c: dates.question_filters(c, [2022, 2023]))) == want


def test_row_dates(spark):
    none = F.array().cast(dates.PAIRS)
    of = lambda q, p=none, y=None, m=None: tuple(one(spark, q, lambda c: dates.row_year_month(c, p, y, m)))
    some = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y, m in ((2020, 3), (2022, 3))])
    assert of("x", some) == (2022, 3)
    assert of("x", some, F.lit(2019), F.lit(None).cast("int")) == (2019, None)
    assert of("from 2018 to 2012") == (2012, None)
    assert of("May 2018") == (2018, 5)
    with pytest.raises(Exception, match="no year"):
        of("nothing")
    with pytest.raises(Exception, match="month out of range"):
        of("x", some, F.lit(2019), F.lit(13))


@pytest.mark.parametrize(
    ("value", "want"),
    [("  a \t\n b ", "a b"), ("a  b　c", "a b c"), ("\x1cq\x1f", "q"), ("", ""), (" ", "")],
)
def test_collapse(spark, value, want):
    assert one(spark, value, text.collapse) == want == " ".join(value.split())


@pytest.mark.parametrize(
    ("value", "want"),
    [("1,009.50", [1009.5]), ("2012-2013", [2012.0, -2013.0]), ("$1,2.5% +3", [12.5, 3.0]), ("20%", [20.0]), ("none", []), ("-$4", [-4.0])],
)
def test_numbers(spark, value, want):
    assert one(spark, value, text.numbers) == want


def test_answers(spark):
    assert one(spark, "$1,009.50 (about)", text.normalize_answer) == "100950 about"
    match = lambda p, g: one(spark, p, lambda c: matching.answer_matches(c, F.lit(g)))
    assert match("it is 101", "100") and not match("102", "100") and not match("none", "100") and match("Yes.", "yes") and match("0.005", "0") and not match("0.1", "0")
    held = lambda a, t: one(spark, t, lambda c: matching.appears(text.normalize_answer(F.lit(a)), text.numbers(F.lit(a)), text.normalize_answer(c), text.numbers(c)))
    assert held("1.5", "in 2015") and held("1,000", "exactly 1000.5") and not held("1,000", "1002") and not held("", "x") and held("five", "Twenty-Five!")


def test_sentences_and_terms(spark):
    assert one(spark, "A b. C d!  E\nf\n\n? g", text.sentences) == ["A b.", "C d!", "E", "f", "?", "g"]
    assert one(spark, "The the of CAT cat-nap é", lambda c: text.terms(c, 2)) == ["the", "cat", "nap"]
    assert one(spark, "see [S12].", text.has_citation) and not one(spark, "see [S1, S2]", text.has_citation)


def test_json_object(spark):
    get = lambda v: one(spark, v, lambda c: F.get_json_object(text.json_object(c), "$.a"))
    assert get('{"a": 1}') == "1" and get('so: {"a": {"b": 2}} ok') == '{"b":2}' and get("[1]") is None and get("no") is None


def judged(spark, value, read):
    return one(spark, json.dumps(value), lambda c: read(F.try_parse_json(c)))


@pytest.mark.parametrize(
    ("v", "n"),
    [(None, 0), (True, 1), (2.7, 2), (-1, 0), ("3", 3), ("", 0), (["2"], 2), (["a", "b"], 2), (["a"], 1), ([], 0), ([{"x": 1}], 1), ({"value": 4}, 4), ({"claims": [1, 2]}, 2), ({"count": None}, 0), ({"total": {"count": [" 5 "]}}, 5), (1e3, 1000)],
)
def test_judge_count(spark, v, n):
    assert judged(spark, v, judging.count) == n


@pytest.mark.parametrize(("v", "n"), [(None, 0), (True, 1), (0.5, 1), (0.4, 0), ("Yes", 1), ("incorrect", 0), ("0.7", 1), (["true"], 1), ({"value": 0}, 0), ({"is_correct": "y"}, 1), ({"correct": [{"value": " No "}]}, 0), ("", 0)])
def test_judge_flag(spark, v, n):
    assert judged(spark, v, judging.flag) == n


@pytest.mark.parametrize("v", ["many", {"x": 1}, "inf", "NaN"])
def test_judge_refuses(spark, v):
    assert judged(spark, v, judging.count) is None
    assert judged(spark, ["a", "b"], judging.flag) is None and judged(spark, "maybe", judging.flag) is None


def test_reply_text(spark):
    text_of = lambda v: one(spark, json.dumps(v, ensure_ascii=False), judging.reply_text)
    assert text_of({"choices": [{"message": {"content": "", "reasoning_content": 'x {"a": 1}'}}]}) == 'x {"a": 1}'
    assert text_of({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}) == "ab"
    assert text_of({"choices": [{"message": {"content": "plain"}}, {"delta": {"content": "{}"}}]}) == "{}"
    assert text_of({"choices": {"text": " é\n{}"}}) == "é\n{}"
    assert text_of({"data": {"output_text": "{}"}}) == "{}"
    assert text_of({"output_text": "none"}) == "none" and text_of([]) == "" and text_of({"x": 1}) == ""
    # Only fields that are named so count, however deep they lie; what was asked doesn't.
    asked = {"correct_answer": 1, "prompt": '{"correct_answer": 1}'}
    assert text_of({"request": asked, "choices": [{"message": {"content": "I cannot say"}}]}) == "I cannot say"
    assert text_of({"request": asked, "log": [{"body": asked}, ['{"a": 1}']]}) == ""
    deep = {"content": [{"text": "{"}, {"content": '"a": 1}'}]}
    for k in range(12):
        deep = {"request": asked, f"k{k}": [deep, {"x": k}]} if k % 2 else [asked, {"y": deep}]
    assert text_of(deep) == '{"a": 1}'
    assert text_of({"a": {"text": {"reasoning": " {} "}}, "b": 1}) == "{}"


def test_verdict_in_many_layers(spark):
    flag, count = 1, 7
    for _ in range(30):
        flag, count = [{"value": flag}], {"count": {"total": count}}
    said = json.dumps({"correct_answer": flag, "total_claims": count})
    assert tuple(one(spark, said, judging.verdict)) == (0, 7, 0, 1)


def test_verdict(spark):
    read = lambda v: one(spark, v, judging.verdict)
    assert tuple(read('Here: {"supported_claims": [1, 2], "total_claims": "3", "correct_answer": "yes"}')) == (2, 3, 0, 1)
    assert read("none") is None and read('{"total_claims": "lots"}') is None and read(None) is None and read('["a"]') is None


def test_citation(spark):
    cols = {"year": F.lit(2024), "month": F.lit(3), "heading": F.lit(None).cast("string"), "source_path": F.lit("p"), "chunk_id": F.lit("c")}
    assert one(spark, "", lambda c: text.citation(["source_path", "year_month", "heading", "chunk_id"], cols.get)) == "p | 2024-03 | unknown heading | c"
    assert one(spark, "", lambda c: text.year_month(F.lit(None).cast("int"), F.lit(None).cast("int"))) == "unknown year-unknown month"
