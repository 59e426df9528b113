"""Source divergence, filter interaction and license scans against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import divergence, filter_audit, licenses

SCHEMA = "doc_id long, text string, lang string, source string, term string, part string, _words string, mask int"


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def docs(spark, rows, parts=3):
    """(doc_id, text, lang, source) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", "y", "z", 9) for r in rows], SCHEMA).repartition(parts)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def divergence_brute(rows, min_docs=3, top=200):
    split = [(lang or "", source or "", re.findall(TERM, low(t))) for _, t, lang, source in rows]
    out = set()
    for lang in {x[0] for x in split}:
        own = [x for x in split if x[0] == lang]
        df = Counter(w for _, _, ts in own for w in set(ts))
        kept = [w for w, n in df.items() if n >= min_docs]
        count = defaultdict(Counter)
        for _, source, ts in own:
            count[source].update(w for w in ts if df[w] >= min_docs)
        whole = sum(count.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in ps:
            pair = [(sum((ps[s][w] - ps[o][w]) ** 2 // ps[o][w] for w in kept), o) for o in ps if o != s]
            term = [((ps[s][w] - q[w]) ** 2 // q[w], w) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out.update((lang, s, part, item, v, k) for k, (v, item) in enumerate(items[:most], 1))
    return out


WORDS = ["a", "B", "b", "é", "É", "日本", "x1y", "the", "The", "zz", "\x7f", "\U0001f600"]


def some_rows(seed, n=60):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3, None, k]), r.choice([None, "", " ".join(r.choices(WORDS, k=r.randint(0, 12)))]), r.choice(["en", "de", None, ""]), r.choice(["s", "t", "u", None])) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_divergence_is_brute_force(spark, seed):
    rows = some_rows(seed)
    got = {(x.lang, x.source, x.part, x.item, x.value, x.rank) for x in divergence.source_divergence(docs(spark, rows), top=3).collect()}
    assert got == divergence_brute(rows, top=3)


def test_counts_that_are_sent_on(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    monkeypatch.setattr(divergence, "AT_ONCE", 3)
    monkeypatch.setattr(divergence, "LONG", 4)
    b = pa.RecordBatch.from_pydict({"text": ["a b a c a", "É a", "a", ""], "lang": ["x"] * 4, "source": ["s", "s", "t", "t"]})
    n, d = Counter(), Counter()
    for out in divergence._count([b.slice(0, 2), b.slice(2, 2)]):
        for x in out.to_pylist():
            n[x["source"], x["term"]] += x["n"]
            d[x["source"], x["term"]] += x["docs"]
    assert n == {("s", "a"): 4, ("s", "b"): 1, ("s", "c"): 1, ("s", "É"): 1, ("t", "a"): 1}
    assert d == {("s", "a"): 2, ("s", "b"): 1, ("s", "c"): 1, ("s", "É"): 1, ("t", "a"): 1}


def test_divergence_edges(spark):
    assert divergence.source_divergence(docs(spark, [])).collect() == []
    # No kept term: pairs of value 0, ties in UTF-8 order; a language's only source has no pairs; repeated rows count each.
    got = divergence.source_divergence(docs(spark, [(1, "a", "en", "é"), (2, "b", "en", "z"), (3, None, "en", None), (4, "q", "fr", "s")])).collect()
    assert {(x.source, x.item, x.value, x.rank) for x in got} == {("é", "", 0, 1), ("é", "z", 0, 2), ("z", "", 0, 1), ("z", "é", 0, 2), ("", "z", 0, 1), ("", "é", 0, 2)}
    rows = [(1, "word", "en", "s")] * 3 + [(2, "other " * 50_000, "en", "t")]
    got = {(x.lang, x.source, x.part, x.item, x.value, x.rank) for x in divergence.source_divergence(docs(spark, rows)).collect()}
    assert got == divergence_brute(rows)


def test_large_counts_stay_exact(spark):
    one = spark.range(1)
    from pyspark.sql import functions as F

    n = 3 * 10**13
    got = one.select(divergence._p(F.lit(n), F.lit(10 * n + 7), F.lit(13)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (10 * n + 20)


def audit_brute(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[lang or ""].append((fails, int(good[i]) if i is not None else 0, int(toxic[i]) if i is not None else 0))
    out = set()
    for part, ds in parts.items():
        res, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = ds
            for k, x in enumerate(order):
                removed, left = [d for d in left if d[0][x]], [d for d in left if not d[0][x]]
                redundant = sum(d[0][x] and any(d[0][y] for y in order[:k]) for d in ds)
                alone = sum(d[0][x] and sum(d[0].values()) == 1 for d in ds)
                shapley[x] += len(removed)
                res.append((order, k + 1, len(left), len(removed), redundant, alone, sum(d[1] for d in removed), sum(d[2] for d in removed)))
        out.update((part, *x, shapley[x[0][x[1] - 1]]) for x in res)
    return out


def audited(spark, rows, labels):
    labelled = spark.createDataFrame([(*x, "m") for x in labels], "doc_id long, quality int, toxic int, mask string")
    return {tuple(x) for x in filter_audit.filter_orders(filter_audit.mask_cells(filter_audit.failure_masks(docs(spark, rows)), labelled)).collect()}


def test_filter_audit_is_brute_force(spark):
    r = random.Random(5)
    many = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", "ABC def", many, many + " $", "same " * 130, many.upper(), "é x |", many + "\tX\n" * 40]
    rows = [(r.choice([None, 1, 2, k]), r.choice(texts), r.choice(["en", "", None, "de"]), "s") for k in range(150)]
    labels = [(1, 1, None), (1, 0, 1), (None, 1, 1), (7, 1, 1), (9, 0, 0), (12, None, 1), (7, 1, 1), (4000, 1, 1)]
    assert audited(spark, rows, labels) == audit_brute(rows, labels)
    assert audited(spark, [], labels) == set()
    assert audited(spark, rows, []) == audit_brute(rows, [])


def test_repeated_ids_with_other_texts(spark):
    rows = [(5, "a", "en", "s"), (5, "b", "en", "s"), (3, "b", "en", "s"), (5, "a", "en", "s"), (9, "a", "de", "s"), (1, "x" * 200_000, "en", "s"), (2, "x" * 200_000, "fr", "s")]
    got = {(x._id, x.part, x["mask"] >= 16): 0 for x in filter_audit.failure_masks(docs(spark, rows)).collect()}
    assert set(got) == {(5, "en", False), (5, "en", True), (3, "en", False), (9, "de", True), (1, "en", False), (2, "fr", True)}


def scan_brute(text, phrases, templates, containment, widths):
    ws = licenses.words_of(text or "")
    places = [(label, i) for label, p in phrases for i in range(len(ws)) if ws[i : i + len(licenses.words_of(p))] == licenses.words_of(p)]
    blocks = set()
    for width in widths:
        own = [t for t in licenses.prepared(templates, containment, widths) if t["width"] == width]
        for s in range(0, max(len(ws) - width, 1), width):
            b = set(ws[s : s + 2 * width])
            hits = [(t, b & set(t["tokens"])) for t in own if 100 * len(b & set(t["tokens"])) >= containment * len(t["tokens"])]
            share = lambda h: len(h[1]) / len(h[0]["tokens"])
            blocks.update((h[0]["label"], s, width, share(h)) for h in hits if not any(h[1] <= o[1] and (h[1] < o[1] or share(o) > share(h)) for o in hits))
    return len(ws), sorted(places), blocks


@settings(max_examples=6, deadline=None)
@given(st.data())
def test_license_scan_is_brute_force(spark, data):
    words = ["a", "b", "c", "d", "e", "É", "7"]
    texts = data.draw(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(words), max_size=40).map(" ".join)), min_size=1, max_size=12))
    templates = [("one", "a b"), ("two", "a b c"), ("three", "d e É 7 a b"), ("two", "c c d")]
    if data.draw(st.booleans()):
        templates[2] = ("three", "d e 7 a b")
    phrases, widths = [("p", "a a"), ("q", "b C")], (3, 8)
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "a b c d", "en", "s")] * 2
    got = licenses.license_scan(docs(spark, rows), phrases=phrases, templates=templates, containment=60, widths=widths).collect()
    text = {k: t for k, t, _, _ in rows}
    assert Counter(x.doc_id for x in got) == Counter(r[0] for r in rows)
    for x in got:
        want = scan_brute(text[x.doc_id], phrases, templates, 60, widths)
        assert (x.n_words, sorted(map(tuple, x.places)), {tuple(b) for b in x.blocks}) == want


def test_licenses_in_prose(spark):
    filler = "some words of prose that stand around " * 40
    rows = [
        (1, filler + "This work is\nlicensed under the GNU General Public License, version 3. " + filler),
        (2, "Licensed under CC BY 4.0."),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 2."),
        (5, filler + "under the license of the version"),
        (6, "Released under THE MIT-License, licensed under the Apache License, Version 2.0"),
        (7, None),
        (8, "x" * 3_000_000),
        (9, "word " * 300_000 + "cc by nc"),
    ]
    got = {x.doc_id: x for x in licenses.license_scan(docs(spark, [(*r, "en", "s") for r in rows])).collect()}
    labels = {i: ({b.label for b in x.places}, {b.label for b in x.blocks}) for i, x in got.items()}
    assert labels == {1: (set(), {"gpl-3"}), 2: (set(), {"cc-by"}), 3: ({"cc-by-nc"}, {"cc-by-nc"}), 4: (set(), {"gpl-2"}), 5: (set(), set()), 6: ({"mit", "apache-2"}, {"mit", "apache-2"}), 7: (set(), set()), 8: (set(), set()), 9: ({"cc-by-nc"}, set())}
    kelvin = licenses.license_scan(docs(spark, [(1, "\u212a K", "en", "s"), (2, "licen\u212ae CC BY\u0130 NC", "en", "s")]), phrases=[("k", "k k"), ("n", "nc")], templates=[("t", "k")]).orderBy("doc_id").collect()
    assert [(x.n_words, [p.start for p in x.places], len(x.blocks)) for x in kelvin] == [(2, [], 1), (4, [3], 0)]
    assert got[9].places[0].start == 300_000 and got[8].n_words == 1 and got[7].n_words == 0


def test_license_scan_has_no_python_and_no_shuffle_of_texts(spark):
    plan = licenses.license_scan(docs(spark, [(1, "a", "en", "s")]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    with pytest.raises(ValueError):
        licenses.prepared([("x", "")], 85, (16,))
    with pytest.raises(ValueError):
        licenses.prepared([("x", "a " * 17)], 85, (16,))
