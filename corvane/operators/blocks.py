"""Exact top-k that leaves blocks out: vectors lie in blocks with a centre and a radius, which bound every score in them.

A query first visits the blocks with the highest bounds, until they hold k vectors; its k-th best score there is a floor.
Then it visits the other blocks whose bound reaches the floor, and no more: nothing in the rest can enter its best k.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from ..sources.scratch import stored
from .vectors import BLOCK_BYTES, CELLS, DIGITS, HITS, _matrix, _raw, as_stored, best, rank_hits

#: Share of a group's blocks that queries want from which they meet all of its rows at once.
MOST_WANTED = 0.25
#: Rows that centres are fitted on, centres at most (both are on the driver), rounds of fitting, rows of a block about.
SAMPLE, MOST_CENTRES, ROUNDS, BLOCK_ROWS = 16_384, 1024, 6, 1024


def centres(v: np.ndarray, n: int) -> np.ndarray:
    """n centres of vectors, by rounds of nearest centre and mean; the first ones are vectors far from those before."""
    c, far = [v[0]], np.full(len(v), np.inf)
    for _ in range(1, n):
        far = np.minimum(far, ((v - c[-1]) ** 2).sum(1))
        c.append(v[far.argmax()])
    c = np.array(c)
    for _ in range(ROUNDS):
        own = nearest(v, c)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, a strip of vectors at a time."""
    half, step = (c * c).sum(1) / 2, max(1, 4_000_000 // len(c))
    return np.concatenate([np.zeros(0, np.int64), *((v[lo : lo + step] @ c.T - half).argmax(1) for lo in range(0, len(v), step))])


def write_blocks(chunks: DataFrame, path: str, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> None:
    """chunks (pos, vector; all of one length, finite) as path/rows, in a folder for each group of blocks, and path/bounds.

    Centres are fitted on at most `sample` rows, those whose positions hash lowest; every row goes to its nearest. A
    centre with many rows has several blocks. bounds: block, centre, radius, n, group: one row a block. Rows without a vector
    are left out; an empty table gives an empty index.
    """
    spark = chunks.sparkSession
    c = chunks.select(F.col("pos").cast("long"), as_stored(chunks).alias("vector")).dropna()
    kind = dict(c.dtypes)["vector"]
    few = c.orderBy(F.xxhash64("pos"), "pos").limit(sample).toArrow()
    n = c.count()
    at = centres(_matrix(few.column("vector")), min(MOST_CENTRES, len(few), max(1, -(-n // block_rows)))) if n else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(at)

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("vector"))
                own = nearest(v, shared.value)
                apart = np.sqrt(((v - shared.value[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("vector"), pa.array(own.astype(np.int32)), pa.array(apart)], ["pos", "vector", "centre", "apart"])

    placed = stored(c.mapInArrow(place, f"pos long, vector {kind}, centre int, apart double"), "placed")
    sizes = placed.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(sizes), "centre").withColumn("block", F.col("centre").cast("long") * 2**31 + F.pmod(F.xxhash64("pos"), F.col("parts"))).drop("parts")
    bounds = rows.groupBy("block", "centre").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(at)], "centre int, at array<double>")
    sized = bounds.orderBy("block").toArrow()
    group = _groups(sized.column("n").to_numpy(), max(1, at.shape[1] // (2 if kind == "array<float>" else 1)))
    of = F.broadcast(spark.createDataFrame(pa.table([sized.column("block"), pa.array(group)], ["block", "group"]), "block long, group long"))
    told = spark.createDataFrame(sized, "block long, centre int, radius double, n long")
    told.join(of, "block").join(F.broadcast(known), "centre").select("block", F.col("at").alias("centre"), "radius", "n", "group").write.mode("overwrite").parquet(f"{path}/bounds")
    rows.join(of, "block").select("pos", "vector", "block", "group").write.mode("overwrite").partitionBy("group").parquet(f"{path}/rows")


def _bounds(v: np.ndarray, c: np.ndarray, radius: np.ndarray, digits: int) -> np.ndarray:
    """What no score of a query in a block exceeds: the product with its centre plus the query's length times the radius,
    and what rounding may add."""
    length = np.sqrt((v * v).sum(1))[:, None]
    return v @ c.T + length * radius * (1 + 1e-9) + 1e-9 * (1 + length * np.sqrt((c * c).sum(1))) + 10.0**-digits


def _groups(n: np.ndarray, dim: int) -> np.ndarray:
    """The number of each block's group: neighbours of about BLOCK_BYTES together."""
    ends = np.cumsum(n * dim * 8)
    return ((ends - n * dim * 8) // BLOCK_BYTES).astype(np.int64)


def _wanted(v: np.ndarray, floor: np.ndarray | None, held, k: int, digits: int) -> np.ndarray:
    """Which blocks each query visits: those with the highest bounds that hold k rows; or, given floors, all that reach them."""
    _, c, radius, n, _ = held
    most = _bounds(v, c, radius, digits)
    if floor is not None:
        return most >= floor[:, None]
    first = np.zeros(most.shape, bool)
    if not most.size or k < 1:
        return first
    top = most.argmax(1)
    first[np.arange(len(most)), top] = True
    # The highest block alone holds k rows nearly always.
    short = np.flatnonzero(n[top] < k)
    order = np.argsort(-most[short], axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    more = np.zeros((len(short), most.shape[1]), bool)
    np.put_along_axis(more, order, before < k, 1)
    first[short] = more
    return first


def _strips(batches, blocks: int):
    """Batches cut so that a matrix of queries by blocks has at most CELLS cells."""
    step = max(1, CELLS // max(1, blocks))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def _visits(queries: DataFrame, shared, k: int, digits: int) -> DataFrame:
    """query_id, block: what each query visits, by its floor if it has that column."""
    floored = "floor" in queries.columns

    def run(batches):
        held = shared.value
        for q in _strips(batches, len(held[0])):
            if len(held[0]):
                r, at = np.nonzero(_wanted(_matrix(q.column("vector")), q.column("floor").to_numpy() if floored else None, held, k, digits))
                yield pa.RecordBatch.from_arrays([q.column("query_id").take(pa.array(r)), pa.array(held[0][at])], ["query_id", "block"])

    return queries.mapInArrow(run, "query_id long, block long")


def _hits_of_group(queries: DataFrame, group: DataFrame, shared, k: int, digits: int) -> DataFrame:
    """query_id, pos, score, stored: the k best of each query in a group of blocks, of the blocks that it visits at least.

    The group, of BLOCK_BYTES about, is sent to all tasks; queries are read where they are, so no vector is shuffled. Where
    queries want many of the blocks they meet all of the group's rows in one product, else each block the queries that want it.
    """
    floored, spark = "floor" in queries.columns, queries.sparkSession
    got = group.select("pos", "vector", "block").toArrow()
    order = np.argsort(got.column("block").to_numpy(), kind="stable")
    name = got.column("block").to_numpy()[order]
    cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True]) if len(name) else np.zeros(1, np.int64)
    sent = spark.sparkContext.broadcast((got.column("pos").to_numpy()[order], _raw(got.column("vector"))[order], name[cuts[:-1]], cuts))
    del got

    def run(batches):
        held, (pos, v, names, cuts) = shared.value, sent.value
        of = np.searchsorted(held[0], names)
        only = (held[0][of], held[1][of], held[2][of], held[3][of], None)
        for q in _strips(batches, max(len(held[0]) if not floored else len(of), len(of) * k)):
            raw, asked = _raw(q.column("vector")), q.column("query_id").to_numpy()
            m = raw.astype(float, copy=False)
            floor = q.column("floor").to_numpy() if floored else None
            wanted = _wanted(m, floor, only, k, digits) if floored else _wanted(m, None, held, k, digits)[:, of]
            some = np.flatnonzero(wanted.any(1))
            if wanted[some].mean(dtype=float) >= MOST_WANTED if len(some) else False:
                r, c, s = best(raw[some], pos, v, k, digits, None if floor is None else floor[some])
                r, c = some[r], pos[c]
            else:
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                for b in np.flatnonzero(wanted.any(0)):
                    who, here = np.flatnonzero(wanted[:, b]), slice(cuts[b], cuts[b + 1])
                    r, c, s = best(raw[who], pos[here], v[here], k, digits)
                    found.append((who[r], pos[here][c], s))
                r, c, s = (np.concatenate([f[j] for f in found]) for j in range(3))
                o = np.lexsort((c, -s, r))
                r, c, s = r[o], c[o], s[o]
                few = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c, s = r[few], c[few], s[few]
            yield pa.RecordBatch.from_arrays([pa.array(asked[r]), pa.array(c), pa.array(s)], ["query_id", "pos", "score"])

    hits = stored(queries.mapInArrow(run, HITS), "group-hits")
    sent.destroy()
    return hits


def _hits_in_blocks(queries: DataFrame, rows: DataFrame, shared, k: int, digits: int) -> DataFrame:
    """query_id, pos, score: the k best of each query in each group, one group after another: one is in memory at a time."""
    spark = queries.sparkSession
    hits = [_hits_of_group(queries, rows.filter(F.col("group") == int(g)), shared, k, digits) for g in np.unique(shared.value[4])]
    return reduce(DataFrame.unionByName, hits) if hits else spark.createDataFrame([], HITS)


def top_k_in_blocks(queries: DataFrame, path: str, k: int, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, pos, score as vectors.top_k() gives them; the visits: query_id, block), over what write_blocks() wrote.

    The bounds are on the driver and in each task: some hundred bytes a block, a thousandth of the rows. A group of blocks is
    on the driver and in each task too, one at a time.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark = queries.sparkSession
    b = spark.read.schema("block long, centre array<double>, radius double, n long, group long").parquet(f"{path}/bounds").orderBy("block").toArrow()
    shared = spark.sparkContext.broadcast((b.column("block").to_numpy(), _matrix(b.column("centre")), *(b.column(c).to_numpy() for c in ("radius", "n", "group"))))
    rows = spark.read.parquet(f"{path}/rows") if b.num_rows else None
    q = stored(spread(queries.select(F.col("query_id").cast("long"), as_stored(queries).alias("vector")).dropna()), "asked")
    found = _hits_in_blocks(q, rows, shared, k, digits)
    floors = rank_hits(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floored = stored(q.join(floors, "query_id", "left").select("query_id", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "floors")
    # The blocks of the first visits reach the floor too.
    return rank_hits(_hits_in_blocks(floored, rows, shared, k, digits), k), _visits(q, shared, k, digits).unionByName(_visits(floored, shared, k, digits)).distinct()
