"""Minimum-cost-flow resharding (operator 5).

From the bytes in each old shard and the capacity of each new one, a minimum-cost flow says how many bytes go from
where to where so that the fewest bytes move. Blocks of documents are then cut to those amounts, and only shards that
gain or lose a block are written again.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _delete, materialise, new_path, table

N_SHARDS = 24
#: Blocks that all old shards are cut into together (at least one each): what the driver plans with. The finer the
#: blocks the nearer the new sizes come to each other; one block is 1/16384 of all bytes, or one document.
BLOCKS = 16_384


def min_cost_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Flows (old x new) that ship all supply within capacity at least cost: successive shortest paths.

    supply and capacity are integers, sum(capacity) >= sum(supply). Each path is found by Bellman-Ford over the
    residual graph, relaxed for all nodes at once. Old shards whose costs are alike are one node, so the work doesn't
    grow with shards that have no place among the new ones; what the node ships is dealt out to them in order.
    """
    kinds, kind = np.unique(cost, axis=0, return_inverse=True)
    if len(kinds) < len(cost):
        kind = kind.ravel()
        together = min_cost_flow(np.bincount(kind, weights=supply, minlength=len(kinds)).astype(np.int64), capacity, kinds)
        flow = np.zeros(cost.shape, np.int64)
        for k in range(len(kinds)):
            own, ends = np.flatnonzero(kind == k), together[k].cumsum()
            upto = supply[own].astype(np.int64).cumsum()
            for lo, hi, i in zip(upto - supply[own], upto, own):  # where (lo, hi) of the node's bytes meets each arc's
                flow[i] = np.maximum(0, np.minimum(hi, ends) - np.maximum(lo, ends - together[k]))
        return flow
    left, room = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    if room.sum() < left.sum():
        raise ValueError("the new shards hold fewer bytes than there are")
    flow, n, m = np.zeros(cost.shape, np.int64), *cost.shape
    cost = cost.astype(float)
    # A first pass ships what is free: paths of least cost, one arc long.
    for i, j in zip(*np.where(cost <= cost.min(initial=0.0))):
        x = min(left[i], room[j])
        flow[i, j] += x
        left[i] -= x
        room[j] -= x
    while left.any():
        d_old = np.where(left > 0, 0.0, np.inf)
        d_new, via_old, via_new = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            reach = d_old[:, None] + cost
            best = reach.argmin(0)
            better = reach[best, np.arange(m)] < d_new - 1e-12
            d_new[better], via_old[better] = reach[best, np.arange(m)][better], best[better]
            back = np.where(flow > 0, d_new[None, :] - cost, np.inf)
            best2 = back.argmin(1)
            better2 = back[np.arange(n), best2] < d_old - 1e-12
            d_old[better2], via_new[better2] = back[np.arange(n), best2][better2], best2[better2]
            if not better.any() and not better2.any():
                break
        j = int(np.where(room > 0, d_new, np.inf).argmin())
        path, at = [], j
        while True:
            i = int(via_old[at])
            path.append((i, at, 1))
            if via_new[i] < 0:
                break
            at = int(via_new[i])
            path.append((i, at, -1))
        x = min(left[i], room[j], *(flow[a, b] for a, b, s in path if s < 0))
        for a, b, s in path:
            flow[a, b] += s * x
        left[i] -= x
        room[j] -= x
    return flow


def places(names: list[str | None], share: np.ndarray) -> list[int]:
    """The new shard that each old one, largest first, becomes, so that the most bytes can stay.

    Old shard a in the place of capacity c keeps min(a, c). The sum is greatest if the largest old shard has the largest
    capacity, and so on, as pairs that cross never keep more. Places of one capacity go to old shards by name, nulls last.
    """
    by_capacity = np.lexsort((np.arange(len(share)), -share))[: len(names)].tolist()
    out = [0] * len(names)
    for c in sorted({share[j] for j in by_capacity}):
        own = [i for i, j in enumerate(by_capacity) if share[j] == c]
        for i, j in zip(sorted(own, key=lambda i: (names[i] is None, names[i] or "")), sorted(by_capacity[i] for i in own)):
            out[i] = j
    return out


def place_blocks(old: np.ndarray, size: np.ndarray, flow: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The new shard of each block: blocks of an old shard, largest first, go where most of its flow is unfilled.

    Then blocks move from the shard most above its capacity to the one most below for as long as that brings the two
    nearer.
    """
    new, need = np.zeros(len(old), np.int64), flow.astype(np.int64).copy()
    for b in np.lexsort((np.arange(len(old)), -size)):
        j = int(need[old[b]].argmax())
        new[b] = j
        need[old[b], j] -= size[b]
    over = np.bincount(new, weights=size, minlength=flow.shape[1]) - capacity
    by = [set(np.flatnonzero(new == j).tolist()) for j in range(flow.shape[1])]
    for _ in range(len(old)):
        a, z = int(over.argmax()), int(over.argmin())
        gap = over[a] - over[z]
        mine = np.fromiter(by[a], np.int64)
        fit = mine[size[mine] < gap] if len(mine) else mine
        if not len(fit):
            break
        b = int(min(fit, key=lambda k: (abs(size[k] - gap / 2), k)))
        by[a].discard(b)
        by[z].add(b)
        new[b] = z
        over[a] -= size[b]
        over[z] += size[b]
    return new


def reshard(docs: DataFrame, old_col: str = "_old", id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS, capacity: list[float] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, old_shard, block, shard, slot.

    old_col names the old shard (any type; null is a shard of its own). The n_shards largest old shards each become a new
    one, chosen so that the most bytes can stay (see places()), and are numbered like it: their bytes stay there for
    nothing, any other arc costs one a byte. The other old shards have no place of their own: their bytes cost the same
    wherever they go, so they count as one, old shard n_shards.
    capacity gives the new shards' relative sizes (default: equal). size: UTF-8 bytes of the text plus 8; null texts
    count none and have the checksum of the empty text. slot: from 0 in each shard without gaps, by (sub-range, id).
    Repeated rows and null ids are rows like any other; rows alike in id and text go to one block. An empty table gives
    an empty result. The driver holds the n_shards largest old shards and the blocks, whatever the number of files.

    No window holds a shard: shards are cut into about sqrt(rows) ranges, whose counts are summed first.
    """
    rows, place = placing(docs, old_col, id_col, text_col, n_shards, capacity, blocks)
    return place(rows).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_k").alias("old_shard"), F.col("_block").alias("block"), "shard", "slot")


def _measured(docs: DataFrame, old_col: str, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text).alias("_crc"), F.col(old_col).cast("string").alias("_old"), *more)


def placing(docs: DataFrame, old_col: str, id_col: str, text_col: str, n_shards: int = N_SHARDS, capacity: list[float] | None = None, blocks: int = BLOCKS):
    """The measured rows of docs (a table), and a function that gives measured rows old shard, block, shard and slot.

    The function may be given the rows with further columns; it shuffles them once, by ranges of (shard, sub-range).
    """
    spark = docs.sparkSession
    rows = materialise(_measured(docs, old_col, id_col, text_col), "reshard-rows")
    share = np.asarray(capacity if capacity is not None else [1.0] * n_shards)
    whole = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    total, n_rows = whole["s"], whole["n"]
    largest = rows.groupBy("_old").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("s"), F.col("_old").asc_nulls_last()).limit(len(share)).collect()
    known = {k: (r["_old"], r["s"], r["n"]) for k, r in zip(places([r["_old"] for r in largest], share), largest)}
    cut = lambda size, n: max(1, min(n * 4, round(blocks * size / max(1, total))))
    other = len(share), cut(total - sum(s for _, s, _ in known.values()), n_rows - sum(n for _, _, n in known.values()))
    names = spark.createDataFrame([(name, k, cut(size, n)) for k, (name, size, n) in known.items()], "_name string, _k int, _cuts int")

    def in_block(rows: DataFrame) -> DataFrame:
        placed = rows.join(F.broadcast(names), F.col("_old").eqNullSafe(F.col("_name")), "left")
        placed = placed.withColumns({"_k": F.coalesce("_k", F.lit(other[0])), "_cuts": F.coalesce("_cuts", F.lit(other[1]))})
        return placed.withColumn("_block", F.pmod(F.xxhash64("_id", "_crc", "_size"), F.col("_cuts").cast("long")).cast("int")).drop("_name", "_cuts")

    placed = in_block(rows)
    sizes = placed.groupBy("_k", "_block").agg(F.sum("_size").alias("s")).orderBy("_k", "_block").collect()
    old, size = np.array([r["_k"] for r in sizes], np.int64), np.array([r["s"] for r in sizes], np.int64)
    caps = np.floor(total * share / share.sum()).astype(np.int64)
    caps[: total - caps.sum()] += 1
    supply = np.bincount(old, weights=size, minlength=len(share) + 1).astype(np.int64)
    cost = 1 - np.eye(len(share) + 1, len(share), dtype=np.int64)
    new = place_blocks(old, size, min_cost_flow(supply, caps, cost), caps) if len(old) else old
    where = spark.createDataFrame([(int(k), int(r["_block"]), int(j)) for k, r, j in zip(old, sizes, new)], "_k int, _block int, shard int")
    ranges = max(1, math.isqrt(n_rows // len(share)) // 4)
    in_shard = lambda placed: placed.join(F.broadcast(where), ["_k", "_block"]).withColumn("_sub", F.pmod(F.xxhash64("_size", "_id", "_crc"), F.lit(ranges)).cast("int"))
    # Counts of (shard, sub-range) are some sqrt(rows) rows.
    counts = in_shard(placed).groupBy("shard", "_sub").count()
    before = materialise(counts.select("shard", "_sub", (F.sum("count").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("count")).alias("_before")), "reshard-slots")
    within = F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("_id", "_crc", "_size", "_k", "_block")) - 1

    def place(rows: DataFrame) -> DataFrame:
        dealt = in_shard(in_block(rows)).repartitionByRange("shard", "_sub").withColumn("_within", within)
        return dealt.join(F.broadcast(before), ["shard", "_sub"]).withColumn("slot", (F.col("_before") + F.col("_within")).cast("long"))

    return rows, place


def touched_shards(plan: DataFrame) -> tuple[list[int], set[int]]:
    """The new shards that gain or lose rows, and those that have rows. The number of shards bounds both."""
    moved = plan.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r["s"] for r in moved.collect()), {r["shard"] for r in plan.select("shard").distinct().collect()}


def write_shards(rows: DataFrame, path: str, full: set[int]) -> None:
    """Write rows with a column shard as path/shard=N and delete the folders of shards that have no rows any more.

    Writing is by dynamic partition overwrite: a shard's folder is replaced as a whole when the job commits, so a lost
    executor or a second run leaves no half-written shard. Drained shards go after that: until then their rows exist
    twice, and a second run deletes them.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        name = f.getPath().getName()
        if re.fullmatch(r"shard=\d+", name) and int(name[6:]) not in full:
            _delete(spark, f"{path}/{name}")


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Write the shards under path/shard=N that gain or lose rows against the old layout, leave all others alone.

    docs holds the rows, plan is reshard()'s result; they are joined by id_col, which has to be different for each
    row: null or repeated keys are refused (op5_resharding places whole rows instead and joins nothing). Returns the
    shards written or drained.
    """
    n = plan.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if n["n"] != n["d"]:
        raise ValueError(f"{id_col} is null or repeated in some rows: give each row a key of its own")
    touched, full = touched_shards(plan)
    todo = plan.filter(F.col("shard").isin(touched)).select(F.col(id_col), "shard", "slot")
    out = docs.join(todo, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").drop("slot")
    write_shards(out, path, full)
    return touched


def reshard_and_write(docs: DataFrame, path: str, old_col: str = "_old", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Plan, write the affected shards whole under path, and return id, size, text_crc32, shard, slot of all rows.

    Size, checksum and slot of a shard that was written come from the files written (which hold slot beside the
    columns of docs); a shard that keeps all its rows stays where it is and is described from the plan.
    """
    rows, place = placing(docs, old_col, id_col, text_col, **kw)
    own = [c for c in docs.columns if c != old_col]
    plan = materialise(place(rows).select("_id", "_size", "_crc", F.col("_k").alias("old_shard"), "shard", "slot"), "reshard-plan")
    touched, full = touched_shards(plan)
    whole = place(_measured(docs, old_col, id_col, text_col, F.struct(*own).alias("_row"))).filter(F.col("shard").isin(touched))
    stays = plan.filter(~F.col("shard").isin(touched)).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot")
    if not touched:
        return stays
    write_shards(whole.select("_row.*", "shard", "slot").sortWithinPartitions("shard", "slot"), path, full)
    schema = whole.select("_row.*", "slot", "shard").schema
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    written = docs.sparkSession.read.schema(schema).parquet(path).select(id_col, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot")
    return written.unionByName(stays)


def op5_resharding(spark, sf_dir: str) -> DataFrame:
    """Old shards: the files that the table lies in; shards that gain or lose a block are written anew."""
    docs = table(spark, sf_dir, "documents").withColumn("_old", F.col("_metadata.file_path"))
    done = reshard_and_write(docs, new_path(spark, "reshard-shards"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
