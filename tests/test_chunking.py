"""Chunking: literal documents, and packing against an independent fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking as C


def blocks(spark, doc):
    return [tuple(b) for b in spark.createDataFrame([(doc,)], "x string").select(C.blocks(F.col("x")).alias("b")).first()["b"]]


def test_windows(spark):
    got = spark.createDataFrame([("a b c d e",), ("",), ("a",)], "x string").select(C.token_windows(F.col("x"), 3, 1).alias("w")).collect()
    assert [r["w"] for r in got] == [["a b c", "c d e"], [], ["a"]]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, 5), (5, -1)])
def test_settings(size, overlap):
    with pytest.raises(ValueError):
        C.check_settings(size, overlap)


def test_blocks(spark):
    doc = "first line\r\nsecond\r\n\r\n## A  Heading ##x \nbody one\n\nbody two\nTABLE 3 of things\na  1  2  3\nb  4  5  6\n"
    assert blocks(spark, doc) == [
        ("Document", "text", "first line\nsecond"),
        ("A Heading ##x", "text", "A Heading ##x\nbody one"),
        ("A Heading ##x", "text", "body two"),
        ("TABLE 3 of things", "table", "TABLE 3 of things\na  1  2  3\nb  4  5  6"),
    ]
    assert blocks(spark, " \n\t\n") == []


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("# One", "One"),
        ("#One", None),
        ("RECEIPTS AND OUTLAYS", "RECEIPTS AND OUTLAYS"),
        ("RECEIPTS AND OUTLAYS.", None),
        ("RECEIPTS 1 OF 2", None),
        ("Table of contents", "Table of contents"),
        ("chart x", "chart x"),
        ("Mostly lower", None),
        ("12 34", None),
        ("A" * 181, None),
        ("##RECEIPTS", "RECEIPTS"),
    ],
)
def test_heading(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(C.heading(F.col("x")).alias("h")).first()["h"] == want


def fold(sizes, tables, size, overlap):
    """Tokens as numbers, in lists: slow and plain."""
    out, cur, at, b, t = [], [], 0, 0, False
    for i, (n, tab) in enumerate(zip(sizes, tables)):
        toks = list(range(at, at + n))
        at += n
        if n > size:
            if cur:
                out.append((cur, b, t))
            lo = 0
            while True:
                out.append((toks[lo : lo + size], i, tab))
                if lo + size >= n:
                    break
                lo += size - overlap
            cur, b, t = [], i, tab
        elif cur and len(cur) + n > size:
            out.append((cur, b, t))
            cur, b, t = (cur[-overlap:] if overlap else []) + toks, i, t or tab
        elif not cur:
            cur, b, t = toks, i, tab
        else:
            cur, t = cur + toks, t or tab
    if cur:
        out.append((cur, b, t))
    return [(c[0], c[-1] + 1, b, t) for c, b, t in out]


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 2), (8, 7), (1, 0)])
def test_pack(spark, size, overlap):
    r = random.Random(size)
    cases = [([r.randint(1, 13) for _ in range(n)], [r.random() < 0.2 for _ in range(n)]) for n in [0, 1, 2] + [r.randint(0, 12) for _ in range(150)]]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(cases)], "i int, s array<int>, t array<boolean>")
    got = {x["i"]: [tuple(c) for c in x["p"]] for x in df.select("i", C.pack(F.col("s"), F.col("t"), size, overlap).alias("p")).collect()}
    for i, (s, t) in enumerate(cases):
        assert got[i] == fold(s, t, size, overlap)


def test_chunks_carry_overlap_and_headings(spark):
    doc = "ONE\na b c\n\nd e f\n\nTWO\ng h i j k l m\n\nn o"
    docs = spark.createDataFrame([(0, "p", 2024, 3, doc), (1, "q", 2024, 3, " \n ")], "doc_pos int, source_path string, year int, month int, text string")
    got = C.chunk_documents(docs, 5, 2).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.heading, r.content_type, r.text) for r in got] == [
        (0, "ONE", "text", "ONE a b c"),
        (1, "ONE", "text", "b c d e f"),
        (2, "TWO", "text", "TWO g h i j"),
        (3, "TWO", "text", "i j k l m"),
        (4, "TWO", "text", "n o"),
    ]
    assert C.index_rows(C.chunk_documents(docs, 5, 2)).select("metadata.chunk_id").first()[0] == "2024_03_00000"
    with pytest.raises(Exception, match="no chunks in document q"):
        C.chunk_documents(docs, 5, 2, required="source_path").collect()


def test_many_blocks_in_one_document(spark):
    """A hundred thousand blocks in one document are packed in seconds, also by way of Spark."""
    r = random.Random(3)
    sizes, tables = [r.choice([0, 1, 5, 40, 90]) for _ in range(100_000)], [r.random() < 0.01 for _ in range(100_000)]
    began = time.process_time()
    got = C.packed(sizes, tables, 80, 10)
    assert time.process_time() - began < 5
    df = spark.createDataFrame([(sizes, tables), (None, None), ([], [])], "s array<int>, t array<boolean>")
    began = time.time()
    rows = df.select(C.pack(F.col("s"), F.col("t"), 80, 10).alias("p")).collect()
    assert time.time() - began < 20
    assert [tuple(c) for c in rows[0].p] == got and rows[1].p is None and rows[2].p == []
