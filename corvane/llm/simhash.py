"""SimHash near-dedup over an inverted index of byte positions with count filtering (operator 9).

A fingerprint is eight positional bytes. Fingerprints that differ in MAX_DIFF = 2 bits at most differ in two bytes at
most, so they share MIN_MATCHES = 6 positional bytes at least: the guaranteed minimum. Of any six positions they then
share four at least, so the index has one posting list for each choice of four of the first six positions and their
bytes: 15 postings a fingerprint, and each close pair meets in a list. Within a list the positional bytes that a pair
shares are tallied, pairs below the minimum are dropped, the others are verified bit by bit.

A list longer than LIST_ROWS isn't tallied pair by pair but dealt out again by two more positions: close pairs share
two of the other four. Those lists hold fingerprints that differ in two bytes only, 65,536 at most by construction; in
long ones each member looks up the 136 fingerprints within two bits of it. Both ways are exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, small_batches, table

SHINGLE, SEED, BITS, MAX_DIFF = 3, 42, 64, 2
POSITIONS = BITS // 8
MIN_MATCHES = POSITIONS - MAX_DIFF
#: Links in a written part.
PART_LINKS = 200_000
#: Rows of a posting list that are tallied pair by pair; rows that a worker takes at a time.
LIST_ROWS, CHUNK_ROWS = 256, 32_768


def _mask(positions) -> int:
    return sum(0xFF << 8 * p for p in positions)


#: The positions of each kind of list, and, for lists that are too long, the kinds of the lists they are dealt out to.
LISTS = list(combinations(range(MIN_MATCHES), MIN_MATCHES - MAX_DIFF))
LONG_LISTS = list(combinations(range(POSITIONS), MIN_MATCHES))
DEALT = [[c for c, at in enumerate(LONG_LISTS) if set(kept) <= set(at)] for kept in LISTS]
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """Of the whole text: a bit is 1 if it is set in over half of the shingles' XXH64; no words: zero."""
    words = text.lower().split()  # bytes know ASCII only: A-Z, and white space [\x20\x09-\x0D]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    h = np.fromiter([digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])], np.uint64, len(words) - SHINGLE + 1)
    if len(h) < 64:
        set_ = ((h[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).sum(0)
    else:
        by = h.view(np.uint8).reshape(-1, 8)
        set_ = np.concatenate([np.bincount(by[:, p], minlength=256) @ _BIT for p in range(8)])
    return int(((2 * set_.astype(np.int64) > len(h)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches):
    for b in batches:
        fps = np.fromiter([fingerprint(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(fps.view(np.int64))], ["_id", "fp"])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each component of the graph with edges a-b over 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally: in how many positions each a and b have the same byte."""
    return ((a ^ b).view(np.uint8).reshape(-1, POSITIONS) == 0).sum(1)


def tally(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of the same group (a list's number, in order) that share MIN_MATCHES bytes and are verified.

    All lists advance together: each row with the next one of its list, then with the one after that, and so on.
    """
    out_i, out_j, at, step = [], [], np.arange(len(fps)), 1
    while len(at := at[: np.searchsorted(at, len(fps) - step)]):
        at = at[group[at] == group[at + step]]
        i = at[shared_bytes(fps[at], fps[at + step]) >= MIN_MATCHES]
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= MAX_DIFF]
        out_i.append(i)
        out_j.append(i + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def probe(fps: np.ndarray, at: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The same for one list of fingerprints, sorted, that agree in the positions `at`: each looks up its neighbours."""
    bits = [np.uint64(1 << (8 * p + i)) for p in range(POSITIONS) if p not in at for i in range(8)]
    out_i, out_j = [], []
    for flip in [*bits, *(x | y for x, y in combinations(bits, MAX_DIFF))]:
        want = fps ^ flip
        place = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
        hit = np.flatnonzero((fps[place] == want) & (fps < want))
        out_i.append(hit)
        out_j.append(place[hit])
    return np.concatenate(out_i), np.concatenate(out_j)


def _stars(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows as stars: a component's first row with each other one."""
    label = _labels(len(fps), i, j)
    other = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[other]], fps[other]


def _chunks(batches):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield held
            held, n = [], 0
    yield held


def _in_lists(batches, masks: np.ndarray, most: int | None):
    """(list kind, fingerprint, group number, long) of rows sorted by list. Lists come whole, but those of more than
    `most` rows, which come in parts, marked long: nothing holds more of a list than a chunk and most rows."""
    w, f, passing = np.zeros(0, np.int32), np.zeros(0, np.uint64), None
    for held in _chunks(batches):
        w = np.concatenate([w, *(b.column("which").to_numpy() for b in held)])
        f = np.concatenate([f, *(b.column("fp").to_numpy().view(np.uint64) for b in held)])
        if not len(f):
            continue
        key = f & masks[w]
        start = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[start, len(f)])
        long = size > most if most else np.zeros(len(size), bool)
        long[0] |= passing == (w[0], key[0])
        # The last list waits for the next rows, if it isn't passed on already.
        cut = len(f) if long[-1] else start[-1]
        passing = (w[-1], key[-1]) if long[-1] else None
        yield w[:cut], f[:cut], np.repeat(np.arange(len(size)), size)[:cut], np.repeat(long, size)[:cut]
        w, f = w[cut:], f[cut:]
    yield w, f, np.zeros(len(f), np.int64), np.zeros(len(f), bool)


def _out(which: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["which", "a", "b"])


def _tallied(most: int):
    """Links (which -1), and the rows of lists that are too long (which: the list's kind, a: the fingerprint)."""

    def run(batches):
        masks = np.array([_mask(at) for at in LISTS], np.uint64)
        for w, f, group, long in _in_lists(batches, masks, most):
            short = f[~long]
            a, b = _stars(short, *tally(group[~long], short))
            yield _out(np.full(len(a), -1), a, b)
            yield _out(w[long], f[long], f[long])

    return run


def _probed(most: int):
    def run(batches):
        masks = np.array([_mask(at) for at in LONG_LISTS], np.uint64)
        for w, f, group, _ in _in_lists(batches, masks, None):
            few = np.bincount(group)[group] <= most if len(f) else np.zeros(0, bool)
            a, b = _stars(f[few], *tally(group[few], f[few]))
            yield _out(np.full(len(a), -1), a, b)
            for g in np.unique(group[~few]):
                own = group == g
                members = np.sort(f[own])
                a, b = _stars(members, *probe(members, LONG_LISTS[int(w[own][0])]))
                yield _out(np.full(len(a), -1), a, b)

    return run


def _dealt(rows: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """Rows of which and fp, each list together and in order. The key isn't a column: kind and fingerprint tell it."""
    key = F.element_at(F.array(*[F.lit(_signed(_mask(at))) for at in lists]), F.col("which") + 1).bitwiseAND(F.col("fp"))
    return rows.repartition("which", key).sortWithinPartitions("which", key)


def find_links(fingerprints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """A table of links a, b between different fingerprints (column fp); their components are those of all links."""
    kinds = F.array(*[F.lit(c) for c in range(len(LISTS))])
    index = fingerprints.select(F.explode(kinds).alias("which"), "fp")
    met = materialise(_dealt(index, LISTS).mapInArrow(_tallied(list_rows), "which int, a long, b long"), "simhash-met")
    again = F.element_at(F.array(*[F.array(*[F.lit(c) for c in to]) for to in DEALT]), F.col("which") + 1)
    long = met.filter("which >= 0").select(F.explode(again).alias("which"), F.col("a").alias("fp")).distinct()
    rest = _dealt(long, LONG_LISTS).mapInArrow(_probed(list_rows), "which int, a long, b long")
    links = materialise(met.filter("which < 0").select("a", "b").unionByName(rest.select("a", "b")).distinct(), "simhash-links")
    drop_table(met)
    return links


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def components(links: DataFrame) -> DataFrame:
    """node, root for each end of a link: min-label contraction, whose rounds grow as the logarithm of the links.

    Each round points every node to its least neighbour, follows that pointer once more, and contracts the links.
    The order of nodes is hashed anew each round, so chains contract by a constant factor. Each round is written to
    the shared folder, in as many parts as its measured number of links asks for; nothing but that number comes to the
    driver.
    """
    maps, edges, turn, written = [], links, 0, None
    while n := edges.count():
        put = lambda df, name, parts=-(-2 * n // PART_LINKS): materialise(df.coalesce(parts), name)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), c.alias("n"))
        to = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        to = put(to.select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a")))["n"].alias("to")), "simhash-point")
        far = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = put(to.join(far, "to").select("node", F.col("far").alias("to")), "simhash-step")
        drop_table(to)
        maps.append(step)
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = put(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-edges")
        if written is not None:
            drop_table(written)
        written = edges
        turn += 1
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = maps[-1].withColumnRenamed("to", "root")
    for step in reversed(maps[:-1]):
        up = root.select(F.col("node").alias("to"), "root")
        root = materialise(step.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root")).coalesce(-(-step.count() // PART_LINKS)), "simhash-roots")
    return root


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (least id in reach).

    Null and empty texts have fingerprint zero and are linked like any other. Null ids are in no way special but
    that a component of null ids alone has component_id null. Repeated rows stay repeated. Other columns are ignored.
    Very long texts are fingerprinted whole.

    Fingerprints, not documents, are linked: equal ones are grouped first (combined on the map side). The last join
    is of plain shuffles with nothing above, which AQE splits where one fingerprint has very many documents.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialise(rows.mapInArrow(_fingerprints, f"_id {kind}, fp long"), "simhash-prints")
    found = component_ids(prints)
    return found.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_ids(prints: DataFrame) -> DataFrame:
    """_id, fp, component_id for rows of _id and fp (a table): fingerprints are grouped, linked, and joined back."""
    reps = materialise(prints.groupBy("fp").agg(F.min("_id").alias("_least")), "simhash-reps")
    roots = components(find_links(reps.select("fp")))
    linked = reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_print = materialise(linked.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.select("_id", "fp").join(by_print.hint("shuffle_hash"), "fp").select("_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents; null and empty texts have fingerprint zero."""
    return simhash_components(table(spark, sf_dir, "documents"))
