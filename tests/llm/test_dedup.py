"""Exact dedup, line dedup and SimHash components against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import exact_dedup, line_dedup, simhash
from corvane.llm.common import table

LONG = "this line is a passage of well over forty characters"
EDGE = [(1, None), (2, ""), (3, "  "), (4, "Aé É a"), (5, "aé É A"), (5, "aé É A"), (None, "aé É A"), (None, None), (8, "x" * 3000), (9, "X" * 3000), (10, "x" * 3001), (11, "x" * 64), (12, "x" * 65)]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup_edges(make):
    got = exact_dedup.radix_groups(make(EDGE)).collect()
    assert len(got) == len(EDGE)
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[low(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want.update((i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter(map(tuple, got)) == want


def test_exact_dedup_many_copies_and_small_radix(make):
    r = random.Random(1)
    rows = [(i, r.choice(["aB", "ab", "abc" * 9, "abc" * 9 + "d", "é" * 7])) for i in range(300)]
    got = exact_dedup.radix_groups(make(rows), first=2, growth=2).collect()
    size, top = Counter(low(t) for _, t in rows), defaultdict(int)
    for i, t in rows:
        top[low(t)] = max(top[low(t)], i)
    assert {(x.doc_id, x.keep_id, x.group_size) for x in got} == {(i, top[low(t)], size[low(t)]) for i, t in rows}


def test_empty_tables(make):
    assert exact_dedup.radix_groups(make([])).collect() == []
    assert line_dedup.line_keep_bitmaps(make([])).collect() == []
    assert simhash.simhash_components(make([])).collect() == []


def lines_brute(rows):
    ws = " \t\n\v\f\r"
    split = [(i, (t or "").split("\n")) for i, t in rows]
    count, first = Counter(), {}
    for i, ls in split:
        for k in {low(x.strip(ws)) for x in ls}:
            if len(k) >= 40:
                count[k] += 1
                first[k] = max(first.get(k, i), i)
    out = {}
    for i, ls in split:
        keep = [x for x in ls if not (count[low(x.strip(ws))] >= 5 and first[low(x.strip(ws))] != i)]
        out[i] = (len(ls), len(ls) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(make):
    r = random.Random(2)
    pool = [LONG, LONG.upper(), " \t" + LONG + "\r", LONG + " two", "short", "", "é" * 40, "é" * 39, LONG + " "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for i in range(120)] + [(200, None), (201, ""), (202, "\n"), (203, LONG + "\n" + LONG)]
    docs = make(rows)
    got = line_dedup.apply_bitmaps(docs, line_dedup.line_keep_bitmaps(docs)).collect()
    want = lines_brute(rows)
    assert len(got) == len(rows)
    for x in got:
        text = line_dedup.kept_text(x.text.encode(), bytes(x.keep_bitmap)).decode()
        assert (x.n_lines, x.n_dropped, text) == want[x._id]


def test_line_dedup_null_and_repeated_ids(make):
    docs = make([(None, LONG), (None, LONG)] + [(i, LONG) for i in (1, 2, 3, 3)])
    got = line_dedup.line_keep_bitmaps(docs).collect()
    assert sorted((x._id is None, x._id or 0, x.n_dropped) for x in got) == [(False, 1, 1), (False, 2, 1), (False, 3, 0), (False, 3, 0), (True, 0, 1), (True, 0, 1)]


def print_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aAbB é\n\t c", max_size=400))
@settings(max_examples=60, deadline=None)
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode()) == print_brute(t)


def test_fingerprint_long():
    t = " ".join(f"w{i * i % 97}" for i in range(900))
    assert simhash.fingerprint(t.encode()) == print_brute(t)


def reach(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    base = [int(x) for x in r.integers(0, 2**63, 12)]
    fps = set(base)
    for b in base[:6]:
        f = b
        for _ in range(60):  # chains and clusters of one to three flips
            f = (f if r.random() < 0.5 else b) ^ sum(1 << int(x) for x in r.choice(64, int(r.integers(1, 4)), False))
            fps.add(f)
    fps = sorted(fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2]
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {x.node % 2**64: x.root for x in simhash.components(simhash.find_links(df)).collect()}
    want = reach(fps, links)
    assert set(got) == {x for p in links for x in p}
    assert len({(got[f], want[f]) for f in got}) == len({got[f] for f in got}) == len({want[f] for f in got})


def test_simhash_components(make):
    rows = [(4, "a b c d"), (3, "A B  C\nD"), (9, None), (7, ""), (8, " "), (1, "p q"), (None, "p q"), (2, "entirely other words are in this one here")]
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in simhash.simhash_components(make(rows)).collect()}
    least = {4: 3, 3: 3, 9: 7, 7: 7, 8: 7, 1: 1, None: 1, 2: 2}
    assert got == {(i, f"{print_brute(t or ''):016x}", least[i]) for i, t in rows}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {x.node: x.root for x in simhash.components(links).collect()}
    assert len(got) == 203 and len({got[i] for i in range(201)}) == 1 and got[1000] == got[1001] != got[0]


@pytest.mark.parametrize("most", [1, 4, 256])
def test_tally_equals_all_pairs(spark, most):
    """Lists of every length: whatever share of them is dealt out again, the components are those of all pairs."""
    r = np.random.default_rng(most)
    fps = {int(x) for x in r.integers(0, 2**63, 40)}
    centre = int(r.integers(0, 2**63))
    fps |= {centre ^ sum(1 << int(x) for x in r.choice(24, int(r.integers(0, 5)), False)) for _ in range(300)}  # one dense group
    fps = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2]
    want = reach(fps, pairs)
    links = simhash.find_links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), most)
    found = [(x.a % 2**64, x.b % 2**64) for x in links.collect()]
    assert len(found) <= len(simhash.LISTS + simhash.LONG_LISTS) * len(fps)
    got = reach(fps, found)
    assert len({(got[f], want[f]) for f in fps}) == len(set(got.values())) == len(set(want.values()))


def test_tally_counts_positions():
    a = np.array([0, 0, 0, 0x0102030405060708], np.uint64)
    b = np.array([0, 1, 0x0101, 0xFF02030405060708], np.uint64)
    assert simhash.shared_bytes(a, b).tolist() == [8, 7, 6, 7]
    f = np.array([0, 0x0101, 0x010101, 3, 7], np.uint64)
    i, j = simhash.tally(np.array([0, 0, 0, 0, 1]), f)
    want = {(x, y) for x in range(4) for y in range(x + 1, 4) if bin(int(f[x] ^ f[y])).count("1") <= 2}
    assert {(int(x), int(y)) for x, y in zip(i, j)} == want


def test_query_equals_brute_force(spark):
    """op9 over a whole table: fingerprints and components against all pairs of fingerprints."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    prints = {d.doc_id: print_brute(d.text or "") for d in docs}
    fps = np.array(sorted(set(prints.values())), np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    root = reach(fps.tolist(), [(int(fps[a]), int(fps[b])) for a, b in zip(i, j)])
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(least.get(root[p], d), d)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf).collect()}
    assert got == {(d, f"{p:016x}", least[root[p]]) for d, p in prints.items()}


def test_very_long_texts(make):
    """Texts of a megabyte, alike but for their last bytes or lines."""
    base = "\n".join(f"line number {i} of a text that is very long indeed" for i in range(20_000))
    rows = [(1, base), (2, base.upper()), (3, base + "x"), (4, base + "\nand one more line that nobody else has anywhere"), (5, base), (6, "short")]
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup.radix_groups(make(rows)).collect()}
    assert got == {1: (5, 3), 2: (5, 3), 5: (5, 3), 3: (3, 1), 4: (4, 1), 6: (6, 1)}
    want = lines_brute(rows)
    docs = make(rows)
    for x in line_dedup.apply_bitmaps(docs, line_dedup.line_keep_bitmaps(docs)).collect():
        assert (x.n_lines, x.n_dropped, line_dedup.kept_text(x.text.encode(), bytes(x.keep_bitmap)).decode()) == want[x._id]
    prints = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_components(make(rows)).collect()}
    assert prints[1] == prints[2] == prints[5] and {prints[i][1] for i in (1, 2, 3, 4, 5)} == {1} and prints[6][1] == 6
