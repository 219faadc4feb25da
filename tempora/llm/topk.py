"""Exact top-k search by distributed histogram selection.

The stated query set meets all rows in blocks of about ``QUERY_BLOCK`` queries;
a block is the only thing that is broadcast. For each query a range that holds
its k-th best score is narrowed in rounds: every task scores all its rows and
reports, of the range's bins, those from the top down to its own k-th score.
No lower bin can hold the global k-th score, so the summed histograms locate it
exactly; the bin that holds it is the next round's range, until it is one score
wide. A last scoring keeps what lies above the k-th score and, of the ties at
it, the k least ids of each task. Equal numbers of rows leave every task however
the scores are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.frames import arrow, new_path, saved

QUERY_BLOCK, ROW_BLOCK, BINS = 2048, 512, 2048


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as double.

    Rows with a null id, a null vector or a null or non-finite component are left
    out, as are empty vectors, which have no component to score.
    """
    x = F.col(f"`{vector_col}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return df.filter(good).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) for each dimension among the vectors of a list column."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    ends = np.cumsum(sizes)
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((int(d), rows, flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]]))
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum is below 2^53, else in 64-bit integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return a @ b.T


def _scores(batches, ids: np.ndarray, by_dim: dict):
    """(query indexes, vec_ids, scores[query, row]) for all rows in blocks; a query's own id scores nothing (masked)."""
    for batch in batches:
        vec_ids = batch.column(0).to_numpy()
        for d, rows, m in _matrix(batch.column(1)):
            if d not in by_dim:
                continue
            at, q = by_dim[d]
            for a in range(0, len(rows), ROW_BLOCK):
                part = rows[a : a + ROW_BLOCK]
                s = _product(q, m[a : a + ROW_BLOCK])
                yield at, vec_ids[part], s, ids[at][:, None] == vec_ids[part][None, :]


def _block(rows) -> tuple[np.ndarray, dict]:
    """Ids, and by dimension the indexes and the matrix of the queries."""
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    dims: dict = {}
    for i, r in enumerate(rows):
        dims.setdefault(len(r["v"]), []).append(i)
    return ids, {d: (np.array(at), np.array([rows[i]["v"] for i in at], np.int64)) for d, at in dims.items()}


def _bounds(top: int, block) -> np.ndarray:
    """|score| is at most each query's L1 norm times ``top``, the largest component of all rows."""
    out = np.zeros(len(block[0]), object)
    for at, q in block[1].values():
        for i, row in zip(at.tolist(), q.tolist(), strict=True):
            out[i] = sum(map(abs, row)) * top
    if len(out) and max(out) >= 2**62:
        raise OverflowError("an inner product may not fit 64 bits")
    return out.astype(np.int64)


def _histograms(shared, k: int, state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, by_dim), (low, high, width) = shared.value, state.value
        counts = np.zeros(len(ids) * BINS, np.int64)
        for at, _, s, own in _scores(batches, ids, by_dim):
            inside = (s >= low[at][:, None]) & (s <= high[at][:, None]) & ~own
            bins = (s - low[at][:, None]) // width[at][:, None] + at[:, None] * BINS
            counts += np.bincount(bins[inside], minlength=len(counts))
        counts = counts.reshape(-1, BINS)
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        q, b = np.nonzero((counts > 0) & (from_top - counts < k))
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _kth(rows: DataFrame, shared, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Each query's k-th best score, or the least where it has fewer than k candidates."""
    spark = rows.sparkSession
    low, high, need = low.copy(), high.copy(), np.full(len(low), k, np.int64)
    down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while (high > low).any():
        width = -(-(high - low + 1) // BINS)
        state = spark.sparkContext.broadcast((low, high, width))
        found = rows.transform(arrow, _histograms(shared, k, state), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        top = found.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") - F.col("n") < k)
        best: dict = {}
        for q, b, n, upto in sorted(top.select("q", "bin", "n", "upto").collect(), key=lambda r: (r[0], -r[1])):  # at most k bins a query
            if q not in best or best[q][1] < need[q]:
                best[q] = (b, upto, upto - n)
        for q in range(len(low)):
            if q in best:
                b, _, before = best[q]
                need[q] -= before
                low[q] += b * width[q]
                high[q] = min(high[q], low[q] + width[q] - 1)
            else:  # a query without candidates
                low[q] = high[q]
        state.unpersist()
    return low


def _winners(shared, k: int, kth: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_dim = shared.value
        held = [np.zeros(0, np.int64)] * 3

        def k_least(q, v, s):
            """All rows over the k-th score; of those at it, the k least ids of each query."""
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            tie = s == kth[q]
            nth = np.cumsum(tie)
            first = np.searchsorted(q, q)
            keep = ~tie | (nth - np.append(0, nth)[first] <= k)
            return [q[keep], v[keep], s[keep]]

        for at, v, s, own in _scores(batches, ids, by_dim):
            q, c = np.nonzero((s >= kth[at][:, None]) & ~own)
            held = [np.concatenate(x) for x in zip(held, (at[q], v[c], s[q, c]), strict=True)]
            if len(held[0]) > 4 * k * len(ids):
                held = k_least(*held)
        q, v, s = k_least(*held)
        yield pa.record_batch([pa.array(ids[q]), pa.array(q.astype(np.int32)), pa.array(v), pa.array(s)], names=["query_id", "q", "vec_id", "score"])

    return run


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k highest integer inner products of each query among all rows but its own, ties to the smaller vec_id.

    Both frames are (vec_id long, v array<long>) as by :func:`integer_vectors`.
    Returns query_id, rank from 1, vec_id, score; fewer than k rows where a query
    has fewer candidates. A candidate with the query's vec_id is its own. Vectors
    of another dimension than the query's aren't its candidates. Repeated rows are
    candidates each; equal queries answer once, queries that share an id but not a
    vector answer each; neither frame has null ids or vectors. Empty tables give an
    empty frame. Products beyond 64 bits raise OverflowError.

    Every block of queries meets all rows, in about five jobs: that is the price of
    an exact answer for a query set that grows with the rows.
    """
    spark = rows.sparkSession
    queries = queries.select("vec_id", "v").distinct()
    n = queries.count()
    path = new_path(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    blocks = -(-n // QUERY_BLOCK)
    parted, top = new_path(spark, "queries"), 0
    if n:
        queries.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).repartition("b").write.partitionBy("b").parquet(parted)  # a block is read alone
        top = rows.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("m")).first()["m"] or 0  # one number
    present = sorted(r["b"] for r in spark.read.parquet(parted).select("b").distinct().collect()) if n else []  # block numbers
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    for b in present:
        block = _block(spark.read.schema(queries.schema).parquet(f"{parted}/b={b}").orderBy("vec_id", "v").collect())
        shared = spark.sparkContext.broadcast(block)
        bound = _bounds(int(top), block)
        kth = _kth(rows, shared, k, -bound, bound)
        found = rows.transform(arrow, _winners(shared, k, kth), "query_id long, q int, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path)


def op5_exact_top_k(spark, sf_dir):
    """Contract query: 20 best of all embeddings for every vec_id divisible by 20."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = saved(integer_vectors(df, "vec_id", "embedding"), "vectors")
    return exact_top_k(rows, rows.filter("vec_id % 20 = 0"), 20)


OP5_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
