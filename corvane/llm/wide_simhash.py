"""Near-dedup at a similarity (operator 9's general interface): wide SimHash fingerprints find pairs, exact sets decide.

64 bits at a distance of two find copies that are almost exact. Texts whose sets of five-word shingles have a Jaccard
similarity J differ in acos(2J / (1 + J)) / pi of a fingerprint's bits on average, 15 % at 0.8, so they need a wider
fingerprint to tell, and lists of fewer positions to meet in. A list is a choice of byte positions; texts that agree in
those bytes meet there, are compared on all 256 bits, and count if the Jaccard similarity of their sets is as high.

The first lists bring most groups together at little cost. What they leave is found by an exact join: sets that are as
similar share one of the first shingles of both, in whatever order all sets are sorted by (prefix filtering).
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, small_batches, text_slices
from .simhash import _labels, components, find_links, fingerprint

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
WORDS, BITS = 4, 256
#: Lists are as many as find a pair of exactly the similarity with the probability RECALL; it may be SPREAD standard
#: deviations above the mean distance.
RECALL, SPREAD = 0.95, 3
#: Of these lists the first are gone through before the exact join. Lists that one shuffle holds at most: what the index
#: takes on disk. Rows of an Arrow batch of the index.
FIRST, AT_ONCE, INDEX_ROWS = 24, 48, 8192
#: Rows of a list up to which each looks for its nearest; in longer ones a search in width gives each a near one.
LIST_ROWS, STRIP = 2048, 64
#: Texts whose shingles are counted, so that frequent ones come last in the sets' order (any order is exact), times that
#: make one frequent, and frequent ones at most.
ORDER_ROWS, FREQUENT, MOST_FREQUENT = 16_384, 3, 1 << 18
#: Rows of a shingle's list up to which its pairs are rows; so are those of longer lists, if they are PAIRS_A_ROW for each
#: row at most. Others make groups, of which blocks of so many sets (SIGNED_ROWS signatures), of so many bytes, are
#: compared by matrix products over so many shingles at a time.
PAIR_ROWS, PAIRS_A_ROW, GROUP_ROWS, SIGNED_ROWS, GROUP_BYTES, COLUMNS_AT_ONCE = 8, 8, 512, 2048, 16_000_000, 2048
#: Cells of a comparison of signatures in hand. Rows whose numbers may be broadcast, to fetch their texts without a shuffle of all.
SIGNED_CELLS, FEW_ROWS = 2_000_000, 100_000
#: Parts of the first shingles that are shuffled one after another: what they take on disk.
TURNS = 6
#: Words of a set's sketch, a bit for each value of a hash's first nine bits, set if an odd number of shingles has it: two
#: sets differ in as many shingles at least as their sketches in bits.
SKETCH = [f"s{k}" for k in range(8)]
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
COLUMNS = [f"w{k}" for k in range(WORDS)]


def max_distance(similarity: float = SIMILARITY) -> int:
    """The bits in which sets of that Jaccard similarity differ on average."""
    return math.ceil(BITS * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def farthest(similarity: float = SIMILARITY) -> int:
    """The bits in which sets of that similarity differ hardly ever more."""
    p = max_distance(similarity) / BITS
    return math.floor(BITS * p + SPREAD * math.sqrt(BITS * p * (1 - p)))


def recall(n: int, size: int, similarity: float = SIMILARITY, most: int | None = None) -> float:
    """The probability that a pair of that similarity, with no third text, meets in one of n lists of size bytes."""
    p, most = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi, farthest() if most is None else most
    total = 0.0
    for d in range(most + 1):
        meets = math.prod((BITS - d - i) / (BITS - i) for i in range(8 * size))
        total += math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) * (1 - (1 - meets) ** n)
    return total


def lists(rows: int, similarity: float = SIMILARITY) -> list[tuple[int, ...]]:
    """The byte positions of each list: so many in a list that unlike texts seldom meet (256 ** bytes > rows)."""
    size = max(3, math.ceil(math.log(max(rows, 2), 256)))
    enough = lambda n: recall(n, size, similarity, farthest(similarity)) >= RECALL
    n = 1
    while not enough(n):
        n *= 2
    n = next(k for k in range(n // 2, n + 1) if k and enough(k))
    rng, found = np.random.default_rng(7), {}
    while len(found) < min(n, math.comb(BITS // 8, size)):
        found[tuple(sorted(rng.choice(BITS // 8, size, replace=False).tolist()))] = None
    return list(found)


def shingle_set(text: bytes) -> np.ndarray:
    """The XXH64 of a text's different shingles (A-Z lower-cased, ASCII white space), in order; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, shingles = xxhash.xxh64_intdigest, zip(*(words[i:] for i in range(min(SHINGLE, len(words)))))
    return np.unique(np.fromiter([digest(b" ".join(s), SEED) for s in shingles], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is that or more, reckoned without rounding at 0.8; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9 else 0
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def wide(text: bytes) -> np.ndarray:
    """Four words of 64 bits, over the set of a text's shingles; zero without words."""
    return print_of(shingle_set(text))


def print_of(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    out = np.empty(WORDS, np.uint64)
    for k in range(WORDS):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        by = (x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8)
        set_ = _BIT[by].sum(0).ravel() if len(h) < 64 else np.concatenate([np.bincount(by[:, p], minlength=256) @ _BIT for p in range(8)])
        out[k] = ((2 * set_ > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)
    return out


def prefix(h: np.ndarray, similarity: float = SIMILARITY, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first shingles of a set: two sets of that similarity share one of them. common: frequent shingles in order,
    and their counts; they come after all others, in order of counts."""
    n = len(h)
    if n and common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        h = h[np.argsort(np.where(common[0][at] == h, common[1][at], 0), kind="stable")]
    return h[: n - math.ceil(similarity * n - 1e-9) + 1] if n else h


def sketch(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """A sketch of two to four bits for each shingle, 64 at least, by the hashes' last bits: unlike sets hardly ever pass it."""
    bits = 64 << max(0, (len(h) * 2 - 1) // 64).bit_length()
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(s: np.ndarray, words: int) -> np.ndarray:
    """A signature (or rows of them) as one of fewer words."""
    while s.shape[-1] > words:
        half = s.shape[-1] // 2
        s = s[..., :half] ^ s[..., half:]
    return s


def may_differ_in(apart: np.ndarray, n1: np.ndarray, n2: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether sets of those sizes that differ in `apart` shingles at least can have the similarity."""
    both = np.minimum((n1 + n2 - apart) / 2, np.minimum(n1, n2))
    return both >= similarity * (n1 + n2 - both) - 1e-9


def _prints(similarity, common):
    def run(batches):
        for b in text_slices(batches):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            narrow = np.fromiter([fingerprint(t) for t in texts], np.uint64, len(texts))
            sets = [shingle_set(t) for t in texts]
            node = np.fromiter([xxhash.xxh3_64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64, len(sets))
            w = np.array([print_of(h) for h in sets], np.uint64).reshape(-1, WORDS)
            firsts = pa.array([prefix(h, similarity, common.value).tobytes() for h in sets], pa.binary())
            n = pa.array([len(h) for h in sets], pa.int32())
            bits = np.array([sketch(h) for h in sets], np.uint64).reshape(-1, len(SKETCH)).view(np.int64)
            signed = pa.array([signature(h).tobytes() for h in sets], pa.binary())
            more = [*(pa.array(w[:, k].copy().view(np.int64)) for k in range(WORDS)), *(pa.array(bits[:, k].copy()) for k in range(len(SKETCH)))]
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("_id"), pa.array(narrow.view(np.int64)), pa.array(node.view(np.int64)), *more, n, firsts, signed], ["_rid", "_id", "fp", "node", *COLUMNS, *SKETCH, "n", "prefix", "signature"])

    return run


def _shingles(batches):
    for b in text_slices(batches):
        sets = [shingle_set(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of some ORDER_ROWS texts, in order, and how many of the texts have them."""
    some = math.ceil(rows.count() / ORDER_ROWS)
    texts = rows.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, some))) == 0).select("text").distinct()
    counted = texts.mapInArrow(_shingles, "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT)
    got = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    token, n = got.column("token").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _sets(batches):
    for b in text_slices(batches):
        sets = [shingle_set(t or b"").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "held"])


def _alike(similarity):
    def run(batches):
        for b in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("a_set", "b_set")]
            keep = pa.array([similar(x, y, similarity) for x, y in zip(*sets)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return run


def _signed_alike(similarity):
    def run(batches):
        for b in batches:
            signed = [[np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("a_signature", "b_signature")]
            n = [b.column(c).to_numpy().astype(np.int64) for c in ("a_n", "b_n")]
            apart = [int(np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum()) for x, y in zip(*signed)]
            yield b.select(["a", "b"]).filter(pa.array(may_differ_in(np.array(apart, np.int64), *n, similarity), pa.bool_()))

    return run


def _joined(batches, rows: int = INDEX_ROWS):
    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _index(first, positions):
    def run(batches):
        for b in _joined(batches):
            w = np.stack([b.column(c).to_numpy() for c in COLUMNS], 1).view(np.uint8).reshape(b.num_rows, -1).astype(np.int64)
            for c, at in enumerate(positions):
                key = np.zeros(b.num_rows, np.int64)
                for p in at:
                    key = key << 8 | w[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, first + c, np.int32)), pa.array(key), *(b.column(x) for x in ["node", "label", *COLUMNS])], ["which", "key", "node", "label", *COLUMNS])

    return run


def close_groups(w: np.ndarray, most: int) -> np.ndarray:
    """For each row the first row that it reaches over rows at most `most` bits apart."""
    return close_tree(w, most)[0]


def close_tree(w: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row that it reaches over rows at most `most` bits apart, and the row that it is reached from.

    A search in width that compares each row with those not reached yet: a tight group is settled by its first rows,
    however many it has, so the work isn't quadratic for groups of near copies.
    """
    first, by, todo = np.arange(len(w)), np.arange(len(w)), np.arange(len(w))
    while len(todo):
        start, todo = todo[0], todo[1:]
        frontier = [start]
        while frontier and len(todo):
            at = frontier.pop()
            near = np.bitwise_count(w[todo] ^ w[at]).sum(1) <= most
            new, todo = todo[near], todo[~near]
            first[new], by[new] = start, at
            frontier.extend(new.tolist())
    return first, by


def nearest_other(w: np.ndarray, label: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, bits between them): for each row the nearest one of another label, if at most `most` bits apart."""
    if len(w) > LIST_ROWS:
        _, by = close_tree(w, most)
        i = np.flatnonzero(label[by] != label)
        return i, by[i], np.bitwise_count(w[i] ^ w[by[i]]).sum(1)
    rows, other, bits = [], [], []
    for lo in range(0, len(w), STRIP):
        apart = np.bitwise_count(w[lo : lo + STRIP, None] ^ w[None]).sum(2).astype(np.int64)
        apart[label[lo : lo + STRIP, None] == label[None]] = BITS + 1
        j = apart.argmin(1)
        d = apart[np.arange(len(j)), j]
        i = np.flatnonzero(d <= most)
        rows.append(i + lo)
        other.append(j[i])
        bits.append(d[i])
    return np.concatenate(rows), np.concatenate(other), np.concatenate(bits)


def _links(most: int):
    """Pairs at most `most` bits apart and their bits: in each list each row with the nearest one of another label."""

    def of(which, key, node, label, w):
        starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[starts, len(key)])
        two = starts[size == 2]
        bits = np.bitwise_count(w[two] ^ w[two + 1]).sum(1)
        near = (bits <= most) & (label[two] != label[two + 1])
        a, b, d = [node[two[near]]], [node[two[near] + 1]], [bits[near]]
        for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
            x, y, bits = nearest_other(w[s : s + n], label[s : s + n], most)
            a.append(node[s + x])
            b.append(node[s + y])
            d.append(bits)
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        pairs, at = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(d[at].astype(np.int32))], ["a", "b", "bits"])

    def run(batches):
        """Rows sorted by list and bytes; the last list of a batch waits for the next one."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(c).to_numpy() for c in ("which", "key", "node", "label")] + [np.stack([b.column(c).to_numpy() for c in COLUMNS], 1).view(np.uint64)]
            if held:
                part = [np.concatenate(x) for x in zip(held, part)]
            last = (part[0] == part[0][-1]) & (part[1] == part[1][-1])
            held = [x[last] for x in part]
            if not last.all():
                yield of(*(x[~last] for x in part))
        if held:
            yield of(*held)

    return run


def _free_shuffles(spark) -> None:
    """Shuffle files go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _pairs(nodes: DataFrame, at: list[tuple[int, ...]], most: int) -> DataFrame:
    """Different pairs a < b of nodes (node, label, words) that are nearest in a list, with their bits.

    The lists are gone through in turns, whose shuffles are given up one by one: disk doesn't grow with their number.
    """
    words, turns = ", ".join(f"{c} long" for c in COLUMNS), []
    for k in range(0, len(at), AT_ONCE):
        index = nodes.select("node", "label", *COLUMNS).mapInArrow(_index(k, at[k : k + AT_ONCE]), f"which int, key long, node long, label long, {words}")
        dealt = index.repartition("which", "key").sortWithinPartitions("which", "key", "node")
        turns.append(materialise(dealt.mapInArrow(_links(most), "a long, b long, bits int").distinct(), "wide-turn"))
        del index, dealt
        _free_shuffles(nodes.sparkSession)
    pairs = turns[0]
    for t in turns[1:]:
        pairs = pairs.unionByName(t)
    out = materialise(pairs.distinct(), "wide-pairs")
    for t in turns:
        drop_table(t)
    return out


def _places(turn: int):
    """A row for each of the first shingles of a set, with its place among them; those of a turn."""

    def run(batches):
        for b in batches:
            firsts = b.column("prefix").to_pylist()
            each = np.fromiter((len(x) // 8 for x in firsts), np.int64, len(firsts))
            ends, token = np.cumsum(each), np.frombuffer(b"".join(firsts), np.uint64)
            at = (np.arange(each.sum()) - np.repeat(ends - each, each)).astype(np.int32)
            own = token % np.uint64(TURNS) == turn
            rest = [pa.array(np.repeat(b.column(c).to_numpy(), each)[own]) for c in ("node", "label", "n", *SKETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(token[own].view(np.int64)), *rest, pa.array(at[own])], ["token", "node", "label", "n", *SKETCH, "at"])

    return run


def may_be_similar(x: tuple, y: tuple, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether rows (label, size, place of the shingle that they share, sketch) of other labels can have the similarity.

    The sets share no more before the shingle than there is, nor after it, and differ in what their sketches differ in.
    """
    (l1, n1, i, s1), (l2, n2, j, s2) = x, y
    both = np.minimum(i, j) + np.minimum(n1 - i, n2 - j)
    ok = (l1 != l2) & (np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-9) & (both >= similarity * (n1 + n2 - both) - 1e-9)
    at = np.flatnonzero(ok)
    one, n1, n2 = s1[at], n1[at], np.broadcast_to(n2, ok.shape)[at]
    two = s2[at] if s2.ndim > 1 else s2
    ok[at] = may_differ_in(np.bitwise_count(one ^ two).sum(1, dtype=np.int64), n1, n2, similarity)
    return ok


def _list_pairs(rows: tuple, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs of a list that may be similar; None if they are more than most."""
    n, a, b, left = len(rows[0]), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], most
    for step in range(1, n if (rows[0] != rows[0][0]).any() else 1):
        i = np.flatnonzero(may_be_similar(tuple(c[: n - step] for c in rows), tuple(c[step:] for c in rows), similarity))
        left -= len(i)
        if left < 0:
            return None
        a.append(i)
        b.append(i + step)
    return np.concatenate(a), np.concatenate(b)


def _list_tree(rows: tuple, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, row that it is reached from) over rows of a list that may be similar."""
    todo, by = np.arange(len(rows[0])), np.arange(len(rows[0]))
    if (rows[0] == rows[0][0]).all():
        return todo[:0], by[:0]
    while len(todo):
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            at = frontier.pop()
            near = may_be_similar(tuple(c[todo] for c in rows), tuple(c[at] for c in rows), similarity)
            by[todo[near]] = at
            frontier.extend(todo[near].tolist())
            todo = todo[~near]
    other = np.flatnonzero(by != np.arange(len(by)))
    return other, by[other]


def _met(similarity: float):
    """Of rows sorted by shingle: the pairs of a list that may be similar, or, where a long list has very many, links between
    rows that reach each other over such pairs (long: true)."""

    def of(token, node, *rows):
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[starts, len(token)])
        place, a, b = np.repeat(size, size), [], []
        for step in range(1, PAIR_ROWS):
            i = np.flatnonzero((token[step:] == token[:-step]) & (place[step:] <= PAIR_ROWS)) if len(token) > step else np.zeros(0, int)
            i = i[may_be_similar(tuple(c[i] for c in rows), tuple(c[i + step] for c in rows), similarity)]
            a.append(node[i])
            b.append(node[i + step])
        long = [False] * len(a)
        for s, n in zip(starts[size > PAIR_ROWS].tolist(), size[size > PAIR_ROWS].tolist()):
            own = tuple(c[s : s + n] for c in rows)
            pairs = _list_pairs(own, similarity, PAIRS_A_ROW * n)
            long.append(pairs is None)
            x, y = _list_tree(own, similarity) if pairs is None else pairs
            a.append(node[s + x])
            b.append(node[s + y])
        long = np.repeat(long, [len(x) for x in a])
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), long], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(bool))], ["a", "b", "long"])

    def run(batches):
        held = None
        for b in _joined(batches):
            part = [b.column(c).to_numpy() for c in ("token", "node", "label", "n", "at")] + [np.stack([b.column(c).to_numpy().view(np.uint64) for c in SKETCH], 1)]
            if held:
                part = [np.concatenate(x) for x in zip(held, part)]
            last = part[0] == part[0][-1]
            held = [x[last] for x in part]
            if not last.all():
                yield of(*(x[~last] for x in part))
        if held:
            yield of(*held)

    return run


def signed_stars(signed: list[np.ndarray], n: np.ndarray, label: np.ndarray, block: np.ndarray, one: int, two: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of pairs between rows of two blocks (or of one) that have other labels and signatures of sets
    that may have that similarity. Of each width's rows, in order of size, strips meet those of sizes that can match."""
    width, a, b = np.array([len(s) for s in signed]), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by = {(k, w): at[np.argsort(n[at], kind="stable")] for k in {one, two} for w in np.unique(width) if len(at := np.flatnonzero((block == k) & (width == w)))}
    for (k, w), x in by.items():
        for (m, v), y in by.items():
            if (k, m) != (one, two):
                continue
            words = min(w, v)
            left, right = (folded(np.stack([signed[i] for i in at]), words) for at in (x, y))
            step = max(1, min(STRIP, SIGNED_CELLS // (len(y) * words)))
            for lo in range(0, len(x), step):
                i = x[lo : lo + step]
                s, e = np.searchsorted(n[y], (similarity * n[i[0]] - 1e-6, n[i[-1]] / similarity + 1e-6))
                j = y[s:e]
                apart = np.bitwise_count(left[lo : lo + step, None] ^ right[None, s:e]).sum(2, dtype=np.int64)
                r, c = np.nonzero(may_differ_in(apart, n[i][:, None], n[j][None], similarity) & (label[i][:, None] != label[j][None]))
                a.append(i[r])
                b.append(j[c])
    root = _labels(len(signed), np.concatenate(a), np.concatenate(b))
    other = np.flatnonzero(root != np.arange(len(signed)))
    return root[other], other


def similar_stars(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, block: np.ndarray, one: int, two: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Stars (first row, other row) of the components of pairs of that similarity between rows of two blocks (or of one)
    that have other labels: every pair is compared."""
    x, y = np.flatnonzero(block == one), np.flatnonzero(block == two)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    often = np.bincount(at, minlength=len(token)) > 1
    new = np.cumsum(often) - 1
    row, at = row[often[at]], new[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS_AT_ONCE):
        s, e = np.searchsorted(at, (lo, lo + COLUMNS_AT_ONCE))
        m = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        m[row[s:e], at[s:e] - lo] = 1
        both += m[x] @ m[y].T
    alike = (both >= similarity * (n[x][:, None] + n[y][None] - both.astype(np.float64)) - 1e-9) & (label[x][:, None] != label[y][None])
    i, j = np.nonzero(alike)
    root = _labels(len(sets), x[i], y[j])
    other = np.flatnonzero(root != np.arange(len(sets)))
    return root[other], other


def _in_blocks(similarity: float, stars):
    """Links of the blocks of sets or signatures; rows sorted by root, one, two come as they are, a pair of blocks is held
    at a time."""

    def of(rows: list):
        t = pa.Table.from_batches(rows).combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("held").to_pylist()]
        node, n, label, block = (t.column(c).to_numpy() for c in ("node", "n", "label", "block"))
        a, b = stars(sets, n.astype(np.int64), label, block, t.column("one")[0].as_py(), t.column("two")[0].as_py(), similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    def run(batches):
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("root", "one", "two")], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and key != tuple(k[lo]):
                    yield of(held)
                    held = []
                key = tuple(k[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield of(held)

    return run


def _group_links(roots: DataFrame, own: DataFrame, held: DataFrame, similarity: float, stars=similar_stars) -> DataFrame:
    """Links within groups (node, root): a group's sets, or signatures (node, held), lie in blocks, and each two blocks meet in
    a task, all pairs compared."""
    rows = roots.join(own.select("node", "label", "n"), "node")
    most, each = (GROUP_ROWS, 8.0) if stars is similar_stars else (SIGNED_ROWS, 0.5)
    size = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most)), F.ceil(F.sum(F.col("n") * each) / F.lit(GROUP_BYTES)))
    sized = rows.groupBy("root").agg(size.cast("int").alias("blocks"), F.count_distinct("label").alias("labels")).filter("labels > 1")
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    dealt = rows.join(sized, "root").withColumn("block", block).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "_x").alias("one"), F.greatest("block", "_x").alias("two"), "block", "node", "label", "n")
    full = dealt.join(held, "node").select("root", "one", "two", "block", "node", "label", "n", "held")
    return full.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two").mapInArrow(_in_blocks(similarity, stars), "a long, b long").distinct()


def _signed(pairs: DataFrame, own: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose signatures leave the similarity open: few but those that have it."""
    held = signatures.join(own.select("node", "n"), "node")
    of = lambda c: held.select(F.col("node").alias(c), F.col("held").alias(f"{c}_signature"), F.col("n").alias(f"{c}_n"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_signature", "b_signature", "a_n", "b_n")
    return materialise(both.mapInArrow(_signed_alike(similarity), "a long, b long"), "wide-signed")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have that Jaccard similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("a_set")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("held").alias("b_set")), "b")
    return materialise(two.select("a", "b", "a_set", "b_set").mapInArrow(_alike(similarity), "a long, b long"), "wide-links")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _narrow_links(prints: DataFrame) -> DataFrame:
    """Links between nodes whose rows the 64-bit fingerprints link (operator 9's contract), as stars."""
    roots = components(find_links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    own = materialise(prints.select("fp", "node").distinct().join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), "wide-narrow")
    least = own.groupBy("root").agg(F.min("node").alias("a"))
    return materialise(own.join(least.hint("shuffle_hash"), "root").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "wide-first")


def _ends(nodes: DataFrame, *pairs: DataFrame) -> DataFrame:
    """node, _rid of the pairs' ends."""
    ends = pairs[0].select("a", "b")
    for p in pairs[1:]:
        ends = ends.unionByName(p.select("a", "b"))
    return materialise(nodes.join(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "_rid"), "wide-ends")


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, held: the shingles of some nodes. Where they are few, texts aren't shuffled."""
    wanted = wanted.hint("broadcast" if wanted.count() <= FEW_ROWS else "shuffle_hash")
    return materialise(rows.select("_rid", "text").join(wanted, "_rid").select("node", "text").mapInArrow(_sets, "node long, held binary"), "wide-sets")


def grouped(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """_rid, _id, node, root for a table of _rid (different for each row), _id and text: root is the same in a group.

    A node is a set of shingles, so rows of one node are alike. Groups are the components of the links of the 64-bit
    fingerprints together with all pairs of the similarity. The first lists link each row to its nearest one of
    another component, which brings large groups together. Then all sets that share one of their first shingles meet,
    unless they are of one component already: pairs whose signatures don't tell them apart are verified one by one. Long
    lists of very many pairs make groups, which signatures take apart first: in what stays together all pairs are
    compared, block by block. No pair of the similarity is left out.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["_id"]
    words, bits = (", ".join(f"{c} long" for c in cs) for cs in (COLUMNS, SKETCH))
    common = rows.sparkSession.sparkContext.broadcast(_common(rows))
    prints = materialise(rows.select("_rid", "_id", "text").mapInArrow(_prints(similarity, common), f"_rid long, _id {kind}, fp long, node long, {words}, {bits}, n int, prefix binary, signature binary"), "wide-prints")
    nodes = materialise(prints.groupBy("node").agg(F.min("_rid").alias("_rid"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in COLUMNS]), "wide-nodes")
    most = farthest(similarity)
    links = _narrow_links(prints)
    labelled = lambda label, *more: materialise(nodes.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "n", *more), "wide-labelled")
    own = labelled(components(links), *COLUMNS)
    pairs = _pairs(own, lists(nodes.count(), similarity)[:FIRST], most)
    drop_table(own)
    sets = _sets_of(rows, _ends(nodes, pairs))
    _free_shuffles(rows.sparkSession)
    # One pair of each node, its nearest, then the others that still join two components.
    first = materialise(pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "wide-some")
    links = links.unionByName(_verified(first, sets, similarity))
    rest = _across(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), components(links))
    links = links.unionByName(_verified(rest, sets, similarity))
    drop_table(sets)

    own = labelled(components(links), "_rid")
    places = prints.select("_rid", "prefix", *SKETCH).join(own.hint("shuffle_hash"), "_rid").select("node", "label", "n", *SKETCH, "prefix")
    places, turns = materialise(places, "wide-places"), []
    for k in range(TURNS):
        _free_shuffles(rows.sparkSession)
        dealt = places.mapInArrow(_places(k), f"token long, node long, label long, n int, {bits}, at int").repartition("token").sortWithinPartitions("token", "node")
        turns.append(materialise(dealt.mapInArrow(_met(similarity), "a long, b long, long boolean").distinct(), "wide-turn"))
        del dealt
    drop_table(places)
    met = turns[0]
    for t in turns[1:]:
        met = met.unionByName(t)
    met = materialise(met.distinct(), "wide-met")
    for t in turns:
        drop_table(t)
    _free_shuffles(rows.sparkSession)
    held = prints.select("_rid", F.col("signature").alias("held")).join(_ends(nodes, met).hint("shuffle_hash"), "_rid")
    held = materialise(held.select("node", "held"), "wide-signatures")
    rest = _signed(met.filter("NOT long").select("a", "b").join(pairs, ["a", "b"], "left_anti"), own, held, similarity)
    reached = components(met.filter("long").select("a", "b"))
    close = materialise(_group_links(reached, own, held, similarity, signed_stars), "wide-close")
    drop_table(held)
    _free_shuffles(rows.sparkSession)
    sets = _sets_of(rows, _ends(nodes, rest, close))
    links = links.unionByName(materialise(_group_links(components(close), own, sets, similarity), "wide-group-links"))
    _free_shuffles(rows.sparkSession)
    links = links.unionByName(_verified(rest, sets, similarity))
    drop_table(sets)
    label = components(links)
    roots = materialise(nodes.select("node").join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "wide-roots")
    return prints.select("_rid", "_id", "node").join(roots.hint("shuffle_hash"), "node").select("_rid", "_id", "node", "root")


def survivors(groups: DataFrame) -> DataFrame:
    """_rid of one row of each group: the least id, null ids last; of rows that share it the least set, then number."""
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("node").alias("s"), F.col("_rid").alias("r"))
    return groups.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.r").alias("_rid"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of docs with _id, text as a string and a number of its own for each row, _rid."""
    others = [F.col(c) for c in docs.columns if c not in ("_id", "_rid", "text", text_col)]
    return materialise(docs.select(*others, F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_rid")), "wide-rows")


def near_duplicate_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, keep_id for each row: keep_id is the same for the rows of a group and the least id of one of them.

    Rows are one group that 64-bit fingerprints link (operator 9's contract) or whose sets of five-word shingles have
    the Jaccard similarity; see grouped(). Null and empty texts are alike. Null ids rank above others, as no minimum.
    Repeated rows stay repeated. All pairs of the similarity are found.
    """
    groups = materialise(grouped(numbered(docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text")), "_own"), similarity), "wide-groups")
    least = groups.groupBy("root").agg(F.min("_id").alias("keep_id"))
    return groups.join(least.hint("shuffle_hash"), "root").select(F.col("_id").alias(id_col), "keep_id")
