"""Vectors: L2 normalisation, inner products, exact top-k of every query at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that may be broadcast; more queries are searched in blocks that are shuffled.
BROADCAST_BYTES = 16_000_000
#: Bytes of doubles in a block of queries or chunks that meet in a task, and in a group of operators/blocks; inner products
#: that a worker holds at a time.
MEET_BYTES, BLOCK_BYTES, CELLS = 16_000_000, 32_000_000, 2_000_000
DIGITS = 6
HITS = "query_id long, pos long, score double"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Divided by the length, or by 1e-12 if it is less."""
    d = doubles(v)
    norm = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(d, lambda x: x / norm)


def check_dimensions(df: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """df, whose rows raise an error if their vector hasn't dim components."""
    v = F.col(vector_col)
    error = F.raise_error(F.concat(F.lit(f"expected {dim} components, got "), F.coalesce(F.size(v).cast("string"), F.lit("null"))))
    return df.withColumn(vector_col, F.when(F.size(v) == dim, v).otherwise(error.cast(df.schema[vector_col].dataType)))


def rank_hits(hits: DataFrame, k: int, query_col: str = "query_id", pos_col: str = "pos") -> DataFrame:
    """rank 1..k by score, ties by corpus position; the planner limits each group before it is shuffled."""
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), pos_col)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero; no zero is negative."""
    y = np.abs(x)
    y *= 10.0**digits
    y += 0.5
    np.floor(y, out=y)
    y /= 10.0**digits
    np.copysign(y, x, out=y)
    y += 0.0
    return y


#: Candidates that are looked at by their highest score first, and how many make that worth while.
RUN, MANY = 64, 4096


def _single(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Both in single precision, and what an inner product of them may be off by for a query of length one; None where single
    precision doesn't reach."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = q.astype(np.float32, copy=False), v.astype(np.float32, copy=False)
        longest = [np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0.0)) for x in (a, b)]
    if not longest[0] * longest[1] < 1e30 or not max(longest) < 1e30:
        return None
    return a, b, 1.01 * (q.shape[1] + 2) * 2.0**-24 * longest[1]


def _likely(q: np.ndarray, v: np.ndarray, k: int, digits: int, floor: np.ndarray | None):
    """(query's row, candidate's row) of all that may be among each query's k best, few more than those: by products in single
    precision, as far as these may be off. The k-th highest of the runs' highest scores is a floor of the k-th best."""
    a, b, off = _single(q, v)
    n, step = len(v), max(1, 2 * CELLS // max(1, len(v)))
    runs = -(-n // RUN)
    b = np.concatenate([b, np.zeros((runs * RUN - n, b.shape[1]), np.float32)])
    slack = 2 * off * np.sqrt(np.einsum("ij,ij->i", a, a, dtype=np.float64)) + 1.001 * 10.0**-digits
    for lo in range(0, len(q), step):
        s = a[lo : lo + step] @ b.T
        s[:, n:] = -np.inf
        high = s.reshape(len(s), runs, RUN).max(2)
        least = np.partition(high, runs - k, axis=1)[:, runs - k].astype(float) if runs >= k else np.full(len(s), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[lo : lo + step])
        least = (least - slack[lo : lo + step])[:, None]
        r, at = np.nonzero(high >= least)
        few, c = np.nonzero(s.reshape(len(s), runs, RUN)[r, at] >= least[r])
        r, c = r[few], at[few] * RUN + c
        yield r[c < n] + lo, c[c < n]


def best(q: np.ndarray, pos: np.ndarray, v: np.ndarray, k: int, digits: int = DIGITS, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's row, score) of each query's k best candidates by rounded score, ties to the smaller pos.

    Never more than k for a query, however many tie. Scores that aren't finite are left out, and those below a query's floor may
    be. Of many candidates single precision finds those that may be the best; scores are sums of doubles either way.
    """
    rows, cols, scores = [], [], []
    none = np.zeros(0, np.int64)

    def keep(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        order = np.lexsort((pos[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        few = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[few])
        cols.append(c[few])
        scores.append(s[few])

    if k and len(q) and len(v) >= MANY and _single(q, v) is not None:
        for r, c in _likely(q, v, k, digits, floor):
            step = max(1, CELLS // max(1, q.shape[1]))
            parts = [np.einsum("ij,ij->i", q[r[lo : lo + step]], v[c[lo : lo + step]], dtype=np.float64) for lo in range(0, len(r), step)]
            keep(r, c, rounded(np.concatenate([np.zeros(0), *parts]), digits))
        return np.concatenate([none, *rows]), np.concatenate([none, *cols]), np.concatenate([np.zeros(0), *scores])
    q, v = q.astype(float, copy=False), v.astype(float, copy=False)
    strip = max(1, CELLS // max(1, len(v)))
    for lo in range(0, len(q) if k and len(v) else 0, strip):
        s = q[lo : lo + strip] @ v.T
        finite = np.isfinite(s)
        s = rounded(s, digits)
        s[~finite] = -np.inf
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        keep(r + lo, c, s[r, c])
    return np.concatenate([none, *rows]), np.concatenate([none, *cols]), np.concatenate([np.zeros(0), *scores])


def as_stored(df: DataFrame) -> Column:
    """df's vectors as floats where they are stored so, else as doubles."""
    return F.col("vector") if dict(df.dtypes)["vector"] == "array<float>" else doubles(F.col("vector"))


def _raw(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as a matrix of the numbers that they are stored as."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _raw(column).astype(float, copy=False)


def _hits(q_ids: np.ndarray, q: np.ndarray, pos: np.ndarray, v: np.ndarray, k: int, digits: int) -> list[pa.Array]:
    r, c, s = best(q, pos, v, k, digits)
    return [pa.array(q_ids[r], pa.int64()), pa.array(pos[c], pa.int64()), pa.array(s, pa.float64())]


def _meet(k: int, digits: int):
    """The hits of a block of queries in a block of chunks."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        none = not x.num_rows or not y.num_rows
        ids = lambda t, c: t.column(c).to_numpy().astype(np.int64) if not none else np.zeros(0, np.int64)
        of = lambda t: _matrix(t.column("vector")) if not none else np.zeros((0, 1))
        return pa.table(_hits(ids(x, "query_id"), of(x), ids(y, "pos"), of(y), k, digits), ["query_id", "pos", "score"])

    return run


def _blocked(q: DataFrame, c: DataFrame, keys: list[str], k: int, digits: int) -> DataFrame:
    """Hits of each query among the chunks that agree with it on the keys: blocks of queries meet blocks of chunks.

    A key is cut into blocks by the bytes of its queries and chunks, so a key that most of them share is many tasks.
    A block is sent once for each block that it meets; the larger blocks are, the less is sent.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.sum(F.size("vector") * 8) / F.lit(MEET_BYTES)).cast("int").alias(name))
    blocks = count(q, "_qn").join(count(c, "_cn"), keys)
    put = lambda col, n, salt: F.pmod(F.xxhash64(col, F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    left = q.join(blocks, keys).select("query_id", "vector", *keys, put("query_id", "_qn", 1).alias("_a"), each("_cn").alias("_b"))
    right = c.join(blocks, keys).select("pos", "vector", *keys, put("pos", "_cn", 2).alias("_b"), each("_qn").alias("_a"))
    both = [*keys, "_a", "_b"]
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(_meet(k, digits), HITS)


def _columns(queries: DataFrame, chunks: DataFrame, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with vectors of doubles, or of floats where they are stored so: these become doubles where they meet, and
    take half the bytes until then. Rows without a vector or a key take no part."""
    q = queries.select(F.col("query_id").cast("long"), as_stored(queries).alias("vector"), *keys).dropna()
    return q, chunks.select(F.col("pos").cast("long"), as_stored(chunks).alias("vector"), *keys).dropna()


def top_k(queries: DataFrame, chunks: DataFrame, k: int, digits: int = DIGITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, pos, score for queries (query_id, vector) over chunks (pos, vector): exact inner products.

    Scores are rounded to `digits` and ranked by score, then position. Queries go to the executors once, if their
    measured size allows it, and each batch of chunks is one matrix product that returns its k best; beyond that,
    blocks of queries meet blocks of chunks in shuffled tasks. The rows are the same; nothing but k rows for each
    query and block is ranked.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark = chunks.sparkSession
    q, c = _columns(queries, chunks)
    size = q.agg(F.sum(F.size("vector") * 8 + 8)).first()[0] or 0
    if size <= broadcast_bytes:
        got = q.toArrow()
        held = spark.sparkContext.broadcast((got.column("query_id").to_numpy().astype(np.int64), _matrix(got.column("vector"))))

        def scan(batches):
            ids, m = held.value
            for b in batches:
                if b.num_rows and len(ids):
                    yield pa.RecordBatch.from_arrays(_hits(ids, m, b.column("pos").to_numpy(), _matrix(b.column("vector")), k, digits), ["query_id", "pos", "score"])

        hits = c.mapInArrow(scan, HITS)
    else:
        one = F.lit(0).alias("_all")
        hits = _blocked(q.select("*", one), c.select("*", one), ["_all"], k, digits)
    return rank_hits(hits, k)


def best_within(queries: DataFrame, chunks: DataFrame, keys: list[str], k: int, digits: int = DIGITS) -> DataFrame:
    """query_id, pos, score: candidates for each query's k best among the chunks that agree with it on the keys.

    Null keys agree with nothing.
    """
    return _blocked(*_columns(queries, chunks, keys), keys, k, digits)


def top_k_joined(pairs: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """The same for (query_id, pos, query_vector, vector) pairs that a join on metadata has brought together."""
    scored = pairs.select("query_id", "pos", F.round(dot(F.col("query_vector"), F.col("vector")), digits).alias("score"))
    return rank_hits(scored, k)
