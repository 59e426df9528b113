"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from corvane.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, part int, v string"


def rows_of(spark, vecs):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in vecs], SCHEMA)


def brute(vecs, k=20, mod=20):
    ids = np.array([i for i, _ in vecs])
    x = np.array([v for _, v in vecs], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % mod == 0):
        s = [(-float((x[q] * x[c]).sum()), int(ids[c])) for c in range(len(ids)) if ids[c] != ids[q]]
        out[int(ids[q])] = [(i, -d) for d, i in sorted(s)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["clusters", "uniform", "norms"])
def test_recall(spark, kind):
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 16))
    if kind == "clusters":
        x += 4 * r.standard_normal((30, 16))[r.integers(0, 30, 3000)]
    if kind == "norms":
        x *= r.lognormal(0, 1, (3000, 1))
    vecs = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(N.nearest(rows_of(spark, vecs), sample=1024)), brute(vecs)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q in got:
        assert len(got[q]) == 20
        for i, s in got[q]:
            a, b = (np.array(vecs[j][1], np.float32).astype(float) for j in (q, i))
            assert s == pytest.approx(float(a @ b), rel=1e-12, abs=1e-12)
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))


def test_many_copies_tie_to_smaller_ids(spark):
    r = np.random.default_rng(2)
    vecs = [(i, [8.0, 4.0, 2.0]) for i in range(1500)] + [(i, r.standard_normal(3).tolist()) for i in range(1500, 2200)]
    got = found(N.nearest(rows_of(spark, vecs), sample=256))
    want = brute(vecs)
    near = [q for q in want if want[q][0][1] == want[q][19][1]]
    assert near
    exact = sum(got[q] == want[q] for q in want) / len(want)
    assert exact >= 0.9


def test_fewer_than_k_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (20, [1.0, 1.0])]
    odd = [(3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [1.0]), (9, [])]
    assert found(N.nearest(rows_of(spark, vecs + odd))) == {0: [(2, 2.0), (20, 1.0), (1, 0.0)], 20: [(2, 2.0), (0, 1.0), (1, 1.0)]}
    twice = vecs + [(2, [2.0, 0.0]), (2, [3.0, 0.0]), (0, [1.0, 0.0])]
    assert found(N.nearest(rows_of(spark, twice)))[0] == [(2, 3.0), (20, 1.0), (1, 0.0)]
    assert N.nearest(rows_of(spark, [])).collect() == []
    assert N.nearest(rows_of(spark, odd)).collect() == []
    assert N.nearest(rows_of(spark, [(0, [1.0])])).collect() == []


def test_parts_are_balanced():
    x = np.random.default_rng(3).standard_normal((501, 8))
    sizes = np.bincount(N.balanced_parts(N.neighbour_graph(x, 10), 8), minlength=8)
    assert sizes.max() - sizes.min() <= 3


def test_query_recall(spark):
    sf = "/root/testdata/sf0.001"
    vecs = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(N.op3_neighbours(spark, sf)), brute(vecs)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
