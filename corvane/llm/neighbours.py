"""Approximate nearest neighbours over learned partitions (operator 3).

A neighbour graph of a bounded sample is cut into balanced parts; a small classifier learns the parts and assigns every
row to one; a second one learns in which parts a vector's neighbours lie and routes each query to the most probable
parts, as many as hold a given share of the probability. Candidates found there are reranked by exact inner products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Rows that the partitions are learned on; the driver and each Python worker hold this many vectors.
SAMPLE = 8192
#: Rows that a partition has about, if the number of partitions lies between the two bounds.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 16, 256
#: Recall on held-out rows of the sample that routing is set to. Neighbours among all rows lie nearer than in a sample.
TARGET_RECALL = 0.93
GRAPH, HIDDEN, K, QUERY_MOD = 20, 128, 20, 20
#: Bytes of a block of candidates or queries, and inner products that a worker holds at a time.
BLOCK_BYTES, CELLS = 4_000_000, 2_000_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with largest inner product for each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + len(s)] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Cut the graph into parts (a power of two) whose sizes differ by one at most, few edges running between them.

    Each cut takes the second eigenvector of the part's walk matrix, splits it at the median, and swaps pairs of
    nodes that lose edges across the cut.
    """
    n = len(graph)
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    part, count = np.zeros(n, np.int64), 1
    while count < parts:
        inside = part[a] == part[b]
        ea, eb = a[inside], b[inside]
        degree = np.bincount(ea, minlength=n) + 1.0
        size = np.bincount(part, weights=degree, minlength=count)
        v = rng.standard_normal(n)
        for _ in range(60):
            v = 0.5 * v + 0.5 * (v + np.bincount(ea, weights=v[eb], minlength=n)) / degree
            v -= (np.bincount(part, weights=v * degree, minlength=count) / size)[part]
            norm = np.sqrt(np.bincount(part, weights=v * v, minlength=count))
            v /= np.maximum(norm, 1e-300)[part]
        order = np.lexsort((np.arange(n), v, part))
        start = np.r_[0, np.cumsum(np.bincount(part, minlength=count))]
        side = np.empty(n, np.int64)
        half = (np.diff(start) + 1) // 2
        side[order] = np.arange(n) - start[part[order]] >= half[part[order]]
        for _ in range(10):
            across = np.bincount(ea, weights=np.where(side[ea] != side[eb], 1.0, -1.0), minlength=n)
            swapped = 0
            for p in range(count):
                own = np.flatnonzero(part == p)
                l, r = own[side[own] == 0], own[side[own] == 1]
                l, r = l[np.argsort(-across[l], kind="stable")], r[np.argsort(-across[r], kind="stable")]
                m = min(len(l), len(r), max(1, len(own) // 20))
                m = int((across[l[:m]] + across[r[:m]] > 2).sum())
                side[l[:m]], side[r[:m]] = 1, 0
                swapped += m
            if not swapped:
                break
        part, count = 2 * part + side, 2 * count
    return part


class Net:
    """Input, one hidden layer, softmax; trained on soft labels by Adam."""

    def __init__(self, dim: int, hidden: int, out: int, scale: float, seed: int = 0):
        r = np.random.default_rng(seed)
        self.scale = scale
        self.p = [r.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), r.standard_normal((hidden, out)) * np.sqrt(1 / hidden), np.zeros(out)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        z = np.maximum(x * self.scale @ a + b, 0) @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 0) -> Net:
        r, m, v, t = np.random.default_rng(seed), [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for e in range(epochs):
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                xs = x[at] * self.scale
                h = np.maximum(xs @ self.p[0] + self.p[1], 0)
                z = h @ self.p[2] + self.p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                d = (z / z.sum(1, keepdims=True) - y[at]) / len(at)
                dh = (d @ self.p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((xs.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.p[i]
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.01 * (g * g - v[i])
                    self.p[i] -= rate * (1 - e / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        return self


class Router:
    """What the sample teaches: assign(vectors) to parts, route(queries) to lists of parts."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, parts: int, recall: float = TARGET_RECALL, k: int = K):
        self.ids, self.x, self.parts = ids, x, parts
        scale = 1 / max(1e-30, float(np.sqrt((x * x).mean())) if len(x) else 1.0)
        _, first = np.unique(x, axis=0, return_index=True)  # copies would be each other's only neighbours
        u = x[np.sort(first)]
        if len(u) <= 4 * parts:
            self.assigner = self.router = None
            self.mass = 1.0
            return
        graph = neighbour_graph(u, GRAPH)
        label = balanced_parts(graph, parts)
        self.assigner = Net(x.shape[1], HIDDEN, parts, scale).fit(u, _shares(graph, label, parts, own=label))
        got = self.assigner(u).argmax(1)
        shares, test = _shares(graph, got, parts), np.arange(len(u)) % 8 == 0
        self.router = Net(x.shape[1], HIDDEN, parts, scale, 1).fit(u[~test], shares[~test])
        # The least mass whose parts hold the wanted share of the held-out rows' neighbours.
        prob = self.router(u[test])
        order = np.argsort(-prob, axis=1)
        found = np.take_along_axis(shares[test], order, 1)
        mass = np.take_along_axis(prob, order, 1).cumsum(1)
        self.mass = next((t for t in np.r_[np.arange(0.5, 0.99, 0.02), 0.99, 0.995, 0.999] if (found * (mass - np.take_along_axis(prob, order, 1) < t)).sum(1).mean() >= recall), 1.0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self.assigner(x).argmax(1) if self.assigner else np.zeros(len(x), np.int64)

    def route(self, x: np.ndarray) -> list[list[int]]:
        """Parts by falling probability until their share is held; the part that x itself falls into comes first, as
        that is where its copies are, which the sample holds once."""
        if not self.router:
            return [[0]] * len(x)
        p = self.router(x)
        p[np.arange(len(x)), self.assign(x)] += 1
        p /= 2
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.take_along_axis(p, order, 1).cumsum(1) - np.take_along_axis(p, order, 1)
        return [o[(b < (1 + self.mass) / 2)].tolist() for o, b in zip(order, before)]


def _shares(graph: np.ndarray, label: np.ndarray, parts: int, own: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((len(graph), parts))
    np.add.at(out, (np.repeat(np.arange(len(graph)), graph.shape[1]), label[graph].ravel()), 1.0)
    if own is not None:
        out[np.arange(len(graph)), own] += graph.shape[1]
    return out / out.sum(1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def best_pairs(q_ids, q, c_ids, c, k: int, floor=None):
    """(query number, candidate number, score) of each query's k largest inner products, ties to the smaller id.

    A matrix product chooses whom to look at; scores are then summed anew, in the same order for each pair, so equal
    vectors have equal scores wherever they lie. floor: scores below it can't be among the k. Queries are taken in
    strips, so that no more than CELLS products are held.
    """
    strip = max(1, CELLS // max(1, len(c)))
    parts = [(lo, _best_pairs(q_ids[lo : lo + strip], q[lo : lo + strip], c_ids, c, k, None if floor is None else floor[lo : lo + strip])) for lo in range(0, len(q), strip)]
    none = [(0, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))]
    return tuple(np.concatenate(x) for x in zip(*((r + lo, i, s) for lo, (r, i, s) in parts or none)))


def _best_pairs(q_ids, q, c_ids, c, k: int, floor):
    s = q @ c.T
    s[q_ids[:, None] == c_ids[None, :]] = -np.inf
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(q), -np.inf)
    if floor is not None:
        least = np.maximum(least, floor)
    slack = 1e-9 * (np.abs(q).sum(1) * np.abs(c).max(initial=0.0) + 1e-300)
    rows, cols = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
    exact = np.empty(len(rows))
    for lo in range(0, len(rows), 65_536):
        exact[lo : lo + 65_536] = (q[rows[lo : lo + 65_536]] * c[cols[lo : lo + 65_536]]).sum(1)
    order = np.lexsort((c_ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    # The same id twice among the candidates counts once, by its best score.
    pair = np.stack([rows, c_ids[cols]], 1)
    if len(np.unique(c_ids)) < len(c_ids):
        keep = np.sort(np.unique(pair, axis=0, return_index=True)[1])
        rows, cols, exact = rows[keep], cols[keep], exact[keep]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[place < k], cols[place < k], exact[place < k]


def _assign(shared):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(shared.value.assign(_matrix(b.column("v"))).astype(np.int32))], ["vec_id", "v", "part"])

    return run


def _route(shared, k: int):
    """Each query's parts, its k best rows of the sample, and the worst of their scores if there are k."""

    def run(batches):
        r = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q, ids = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            rows, cols, score = best_pairs(ids, q, r.ids, r.x, k)
            floor = np.full(len(q), -np.inf)
            full = np.bincount(rows, minlength=len(q)) == k
            if len(rows):
                np.minimum.at(worst := np.full(len(q), np.inf), rows, score)
                floor[full] = worst[full]
            cuts = np.searchsorted(rows, np.arange(len(q) + 1))
            near = [[{"vec_id": int(r.ids[c]), "score": float(s)} for c, s in zip(cols[x:y], score[x:y])] for x, y in zip(cuts, cuts[1:])]
            kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(floor), pa.array(r.route(q), pa.list_(pa.int32())), pa.array(near, kind)], ["vec_id", "v", "floor", "parts", "near"])

    return run


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        q_ids, c_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        rows, cols, score = best_pairs(q_ids, _matrix(left.column("v")), c_ids, _matrix(right.column("v")), k, left.column("floor").to_numpy())
        return pa.table([pa.array(q_ids[rows]), pa.array(c_ids[cols]), pa.array(score)], names)

    return run


def learn(rows: DataFrame, n_rows: int, sample: int = SAMPLE, recall: float = TARGET_RECALL, k: int = K) -> Router:
    """A Router from the `sample` rows (vec_id, v) whose hashes of vec_id are smallest.

    Rows whose hashes are too large to be among them are left out before anything is shuffled: the bound lets through
    twice the sample on average, and all of a small table.
    """
    slots = 1 << 31
    few = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(slots)) < min(slots, slots * (2 * sample + 1000) // max(1, n_rows)))
    got = few.dropDuplicates(["vec_id"]).orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(slots)), "vec_id").limit(sample).toArrow()
    ids = got.column("vec_id").to_numpy()
    parts = LEAST_PARTS
    while parts * PART_ROWS < n_rows and parts < MOST_PARTS:
        parts *= 2
    return Router(ids, _matrix(got.column("v")) if len(ids) else np.zeros((0, 1)), parts, recall, k)


def nearest(vectors: DataFrame, k: int = K, query_mod: int = QUERY_MOD, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id query_mod divides, its k nearest among all other rows.

    Nearness: largest inner product in double precision of the vectors as given; ties to the smaller id. Rows take no
    part whose id is null, or whose vector is null, zero, holds null or non-finite components, or hasn't the
    commonest length. Of rows that share an id the best counts, once; no row with the query's id is its neighbour.
    Fewer than k other rows: all of them. Other columns are ignored; an empty table gives an empty result.

    Every row is indexed. A part may hold any share of the rows (copies all fall into one): parts are cut into blocks
    of candidates and of queries by bytes, and each pair of blocks is a task of its own, so no task holds a part and a
    vector is sent once for each block that it meets. The sample's
    k best give each query a floor that later candidates must reach, which keeps what the blocks return small.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    lengths = sorted(rows.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))
    dim, n_rows = (lengths[0]["d"], lengths[0]["count"]) if lengths else (0, 0)
    rows = rows.filter(F.size("v") == dim)
    shared = spark.sparkContext.broadcast(learn(rows, n_rows, sample, recall, k))
    indexed = materialise(rows.mapInArrow(_assign(shared), "vec_id long, v array<double>, part int"), "ann-index")
    queries = indexed.filter(F.col("vec_id") % query_mod == 0).select("vec_id", "v")
    routed = materialise(queries.repartition(F.col("vec_id")).mapInArrow(_route(shared, k), "vec_id long, v array<double>, floor double, parts array<int>, near array<struct<vec_id: long, score: double>>"), "ann-queries")
    # The parts' sizes, a few numbers for each of at most MOST_PARTS parts.
    held = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}
    rows_of_block = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    cuts = spark.createDataFrame([(p, -(-held[p] // rows_of_block), -(-asked.get(p, 0) // rows_of_block)) for p in held] or [(-1, 1, 1)], "part int, cb int, qb int")
    cuts = F.broadcast(cuts)
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n.cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    c = indexed.join(cuts, "part").filter("qb > 0").select("vec_id", "v", "part", block(F.col("cb"), 1).alias("c"), each(F.col("qb")).alias("q"))
    q = routed.select("vec_id", "v", "floor", F.explode("parts").alias("part")).join(cuts, "part").select("vec_id", "v", "floor", "part", block(F.col("qb"), 2).alias("q"), each(F.col("cb")).alias("c"))
    found = q.groupBy("part", "c", "q").cogroup(c.groupBy("part", "c", "q")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    near = routed.select(F.col("vec_id").alias("query_id"), F.explode("near").alias("n")).select("query_id", "n.vec_id", "n.score")
    once = found.unionByName(near).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every twentieth vector among all; vectors that can't be compared take no part."""
    return nearest(table(spark, sf_dir, "embeddings"))
