"""Mixing sources to target weights (operator 6).

Each source's words are packed into blocks of fixed length. Each output shard draws how many blocks it takes of each
source (multinomial, within what the source has left); the slots so drawn go through a pseudorandom permutation of the
source's block numbers, and blocks are joined by number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK_WORDS = 128
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Slots that one output shard takes at most; there are OUT_SHARDS shards at least.
SHARD_SLOTS, OUT_SHARDS, SEED = 250_000, 32, 20240
#: Tasks that draw slots; each draws those of as many output shards as it takes.
MOST_TASKS = 4096


def fill_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: share * sum(sizes) by weight; none above most times its size, the excess by weight."""
    target, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = min(share, most) * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            target[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def _draw(left: np.ndarray, need: int, rng) -> np.ndarray:
    """Multinomial counts that sum to need, none above what is left of its source."""
    got = np.zeros_like(left)
    while need and (left > got).any():
        rest = left - got
        more = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        got += more
        need -= int(more.sum())
    return got


def shard_slots_of(totals: np.ndarray, shards: int, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to which slot of each source one output shard takes.

    All shards' slots are halved again and again; how many of each source fall into the left half is a multinomial draw
    that depends on the seed and the half alone. So a task draws its own shard's counts, and all shards' together sum to
    totals, with no list of all draws anywhere.
    """
    first, n, lo, left = 0, shards, np.zeros(len(totals), np.int64), totals.astype(np.int64)
    while n > 1:
        half = n // 2
        got = _draw(left, int(left.sum()) * half // n, np.random.default_rng([seed, first, n]))
        if shard < first + half:
            n, left = half, got
        else:
            first, n, lo, left = first + half, n - half, lo + got, left - got
    return lo, lo + left


def draw_counts(totals: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Multinomial counts per output shard (shards x sources), whose sums over all shards are totals."""
    return np.stack([np.subtract(*shard_slots_of(totals, shards, seed, o)[::-1]) for o in range(shards)])


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at index: a four-round Feistel network, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), index.astype(np.uint64), np.arange(len(index))
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64) | np.uint64(1)
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= k
            a, b = b, a ^ ((f >> np.uint64(31)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _slots(totals: np.ndarray, blocks: np.ndarray, shards: int, seed: int):
    def run(batches):
        for b in batches:
            for o in b.column("id").to_pylist():
                los, his = shard_slots_of(totals, shards, seed, o)
                for s in np.flatnonzero(his > los).tolist():
                    n = int(blocks[s])
                    for at in range(int(los[s]), int(his[s]), 65_536):
                        slot = np.arange(at, min(at + 65_536, int(his[s])), dtype=np.int64)
                        epoch, block = slot // n, np.empty(len(slot), np.int64)
                        for e in np.unique(epoch):
                            one = epoch == e
                            block[one] = permute(slot[one] - e * n, n, (seed * 1_000_003 + s) * 1_009 + int(e))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), o, np.int32)), pa.array(np.full(len(slot), s, np.int32)), pa.array(slot), pa.array(epoch.astype(np.int32)), pa.array(block)], ["out_shard", "_s", "slot", "epoch", "_block"])

    return run


def measure(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A table of _rid (a number for each row), _id, _source, _size in words, _h, and the columns named in keep."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), text.alias("_text"), *(keep or []))
    rows = rows.select("_id", "_source", F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_size"), F.xxhash64("_text").alias("_h"), *(keep or []), F.monotonically_increasing_id().alias("_rid"))
    return materialise(rows, "mix-rows")


def mix(measured: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shard_slots: int = SHARD_SLOTS, out_shards: int = OUT_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(pieces, sources) of the mix of measure()'s rows.

    pieces: out_shard, slot, epoch, _rid, lo, hi: output shard out_shard takes words lo..hi-1 of row _rid. sources:
    _source, source_size, target. Sources are taken in code point order, null last, and weigh `weights` in turn.
    A source's blocks are used up before any is used again, so no row is taken more than ceil(most) times; targets
    are met within a block. Rows without words take no part. Order within a source follows a hash of id and text, so
    reruns agree; rows that are alike in id and text may swap places. Sources are what the driver holds.

    Running sums are over about sqrt(rows) ranges of each source, then within a range: no window holds a source.
    """
    spark = measured.sparkSession
    found = sorted(measured.groupBy("_source").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes, n_rows = [r["s"] for r in found], sum(r["n"] for r in found)
    target = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    totals = np.array([min(round(t * n / s), math.floor(most * n)) if s else 0 for t, n, s in zip(target, blocks.tolist(), sizes)], np.int64)
    shards = max(out_shards, -(-int(totals.sum()) // shard_slots))
    sources = spark.createDataFrame([(r["_source"], k, r["s"], float(target[k])) for k, r in enumerate(found)], "_source string, _s int, source_size long, target double")
    slots = spark.range(0, shards, 1, min(shards, MOST_TASKS)).mapInArrow(_slots(totals, blocks, shards, seed), "out_shard int, _s int, slot long, epoch int, _block long")
    ranges = max(1, math.isqrt(n_rows))
    rows = measured.filter("_size > 0").select("_rid", "_id", "_h", "_size", "_source").join(F.broadcast(sources.select(F.col("_source").alias("_name"), "_s")), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source")
    rows = rows.withColumn("_range", F.pmod(F.xxhash64("_h", "_id"), F.lit(ranges)).cast("int"))
    sums = rows.groupBy("_s", "_range").agg(F.sum("_size").alias("_sum"))
    starts = materialise(sums.select("_s", "_range", (F.sum("_sum").over(Window.partitionBy("_s").orderBy("_range")) - F.col("_sum")).alias("_from")), "mix-starts")
    within = F.sum("_size").over(Window.partitionBy("_s", "_range").orderBy("_id", "_h", "_rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    at = rows.join(starts, ["_s", "_range"]).select("_rid", "_s", "_size", (F.col("_from") + within).alias("_at"))
    parts = at.select("*", F.explode(F.sequence(F.floor(F.col("_at") / block_words), F.floor((F.col("_at") + F.col("_size") - 1) / block_words))).alias("_block"))
    parts = parts.select("_rid", "_s", "_block", F.greatest(F.lit(0).cast("long"), F.col("_block") * block_words - F.col("_at")).alias("lo"), F.least(F.col("_size"), (F.col("_block") + 1) * block_words - F.col("_at")).alias("hi"))
    # By merging: the planner knows nothing of what _slots() returns and would broadcast it, though it grows with the words.
    return slots.join(parts.hint("merge"), ["_s", "_block"]).select("out_shard", "slot", "epoch", "_rid", "lo", "hi"), sources


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them; null texts have none."""
    measured = measure(table(spark, sf_dir, "documents"))
    pieces, sources = mix(measured)
    taken = pieces.groupBy("_rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    named = sources.select(F.col("_source").alias("_name"), "source_size", "target")
    rows = measured.select("_rid", "_id", "_size", "_source").join(taken, "_rid", "left").join(F.broadcast(named), F.col("_source").eqNullSafe(F.col("_name")))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
