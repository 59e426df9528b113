"""The pipeline's stages, each against a plain version on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from corvane.llm import mixing, pieces, quality, simhash, wide_simhash
from corvane.llm.common import table

from .test_dedup import lines_brute, print_brute, reach

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again as on a cluster."""
    docs = table(spark, SF, "documents")
    lines = docs.limit(0)
    r, shared = random.Random(0), "a passage that many documents have in common, word for word"
    extra = [(10_000 + i, f"document {i} says " + " ".join(r.choices(["one", "two", "three", "four", "five"], k=30)) + f"\n{shared}\nend {i}", "en", f"src{i % 3}", None) for i in range(30)]
    extra += [(20_000, None, None, None, None), (20_001, "", "en", None, 0), (20_002, "same words here", "en", "src0", 15), (20_003, "Same  words HERE", "en", "src1", 16), (20_003, "same words here", "en", "src1", 15)]
    docs = docs.unionByName(lines).unionByName(spark.createDataFrame(extra, docs.schema))
    out, root = [docs], tmp_path_factory.mktemp("p")
    for name, f in P.STAGES:
        df = f(spark, out[-1], SF)
        df.write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "encode"]
    for rows in stages[:-1]:
        assert set(rows[0]) == set(P.COLUMNS)


def test_quality_keeps_what_scores(spark, stages):
    docs = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in stages[0]], table(spark, SF, "documents").schema)
    model = quality.train(docs, quality.labels_of(spark, SF))
    want = Counter(r["doc_id"] for r in stages[0] if model.score(np.array([model.measure((r["text"] or "").encode())]))[0] >= quality.THRESHOLD)
    assert Counter(r["doc_id"] for r in stages[1]) == want and 0 < len(stages[1]) <= len(stages[0])


def test_lines(stages):
    unique = [r for r in stages[1] if r["doc_id"] != 20_003]
    want = lines_brute([(r["doc_id"], r["text"]) for r in unique])
    got = {r["doc_id"]: r for r in stages[2]}
    assert len(stages[2]) == len(stages[1])
    for r in unique:
        assert (got[r["doc_id"]]["text"] or "") == want[r["doc_id"]][2]
        assert got[r["doc_id"]]["n_chars"] == (None if r["text"] is None else len(want[r["doc_id"]][2]))
    assert any(n for _, n, _ in want.values())


def test_one_of_each_group_stays(stages):
    """All pairs, first by the 64-bit fingerprints, then by the 256-bit ones of those groups' least rows."""
    fps, texts = {}, {}
    for r in stages[2]:
        fps.setdefault(print_brute(r["text"]), []).append(r["doc_id"])
        texts.setdefault(r["doc_id"], r["text"])
    nodes = list(fps)
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if bin(a ^ b).count("1") <= 2]
    groups = defaultdict(list)
    for f, root in reach(nodes, links).items():
        groups[root] += fps[f]
    least = sorted(min(g) for g in groups.values())
    w = np.array([wide_simhash.wide((texts[i] or "").encode()) for i in least])
    apart = np.bitwise_count(w[:, None, :] ^ w[None, :, :]).sum(2)

    def survivors(most):
        near = [(a, b) for i, a in enumerate(least) for j, b in enumerate(least[:i]) if apart[i, j] <= most]
        by = defaultdict(list)
        for i, root in reach(least, near).items():
            by[root].append(i)
        return {min(g) for g in by.values()}

    got = [r["doc_id"] for r in stages[3]]
    # Every pair well within the distance is found; pairs at its edge nearly always.
    assert len(set(got)) == len(got) and survivors(wide_simhash.max_distance()) <= set(got) <= survivors(24)
    assert len(got) < len(stages[2])


def test_mix(stages):
    size = lambda t: len(P._WORD.findall(t or ""))
    per, own, taken = defaultdict(int), {}, Counter()
    for r in stages[3]:
        per[r["source"]] += size(r["text"])
        own[r["doc_id"]] = r["text"]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fill_targets([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got = defaultdict(int)
    for r in stages[4]:
        got[r["source"]] += size(r["text"])
        taken[r["doc_id"]] += size(r["text"])
        assert set(P._WORD.findall(r["text"])) <= set(P._WORD.findall(own[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    assert all(n <= 2 * size(own[i]) for i, n in taken.items())
    for s in names:
        assert abs(got[s] - targets[s]) <= 2 * mixing.BLOCK_WORDS


def test_encode(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"]))) for r in stages[4])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5]) == want and all(r["round_trip"] for r in stages[5])


@pytest.mark.parametrize(("text", "spans", "want"), [("a  b\nc d", [(1, 2), (2, 4)], "b\nc d"), (" a b ", [(0, 2)], " a b "), ("a b c d", [(3, 4), (0, 1)], "a\nd")])
def test_cut_words(text, spans, want):
    assert P.cut_words(text, spans) == want


def test_run(spark):
    got = P.run(spark, SF)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert simhash.SHINGLE == 3


def test_near_dup_keeps_rows_not_ids(spark):
    """Null ids and ids that repeat with unlike texts: each text stays once."""
    r = random.Random(8)
    texts = [" ".join(r.choices([f"v{i}" for i in range(900)], k=60)) for _ in range(40)]
    ids = [None] * 20 + [7] * 10 + list(range(100, 110))
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)]
    rows += [(None, texts[0], "en", "s", 1), (7, texts[25], "en", "s", 1), (500, texts[3], "en", "s", 1), (101, texts[31], "en", "t", 1)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema).repartition(3)
    got = P.near_dup_stage(spark, docs, SF).collect()
    assert Counter(x["text"] for x in got) == Counter(texts)
    own = {x["text"]: x["doc_id"] for x in got}
    assert own[texts[3]] == 500 and [own[t] for t in texts[:3]] == [None] * 3 and own[texts[25]] == 7


def test_stages_without_rows_and_with_more_columns(spark):
    """Empty tables, and columns that bear the names of inner ones."""
    docs = table(spark, SF, "documents")
    more = docs.limit(20).select("*", *[F.lit(1).alias(c) for c in ("_id", "_row", "_rid", "_size", "_source", "node", "fp", "hi", "label", "keep_bitmap")])
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        out = stage(spark, more, SF)
        assert out.count() > 0 and (name == "encode" or out.columns == P.COLUMNS), name


def test_stages_take_long_texts_whole(spark):
    r = random.Random(9)
    long = "\n".join(" ".join(r.choices([f"w{i}" for i in range(3000)], k=12)) for _ in range(8000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", len(long) + 4), (3, "other words altogether here", "en", "s", 27)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    assert {x.doc_id: x.text for x in P.line_stage(spark, docs, SF).collect()} == {i: t for i, t, *_ in rows}
    assert sorted(x.doc_id for x in P.near_dup_stage(spark, docs, SF).collect()) == [1, 3]
    words = Counter()
    for x in P.mix_stage(spark, docs, SF).collect():
        words[x.doc_id] += len(P._WORD.findall(x.text))
    assert all(n <= 2 * len(P._WORD.findall(t)) for (i, t, *_), n in zip(rows, map(words.get, (1, 2, 3))) if n)
    assert {x.doc_id: x.round_trip for x in P.encode_stage(spark, docs, SF).collect()} == {1: True, 2: True, 3: True}
