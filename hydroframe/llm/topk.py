"""Exact top-k search (operator 3): exhaustive term-at-a-time accumulation.

Candidates lie in blocks, each indexed as postings: for every dimension the rows
with a weight there.  For a block of queries, every dimension in turn scatters
weight times posting weights into a dense array of integer scores; a partition
selection keeps k of each query and block; the kept rows are merged by query.

Every block of candidates meets every block of queries (a stated query set
against all rows), so a task holds two blocks of bounded size, whatever the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most, and bytes of its weights; queries that are scored at once.
QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_BYTES, STRIP = 16384, 8192, 32 << 20, 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, weights) with weights floor(scale * x), x as double.

    Rows without id, without vector, or with a null or non-finite component are
    left out; an empty vector stays and scores 0.  Of rows with one vec_id the
    least vector stands for all.
    """
    as_double = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(finite)
    weights = F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), weights.alias("weights")).groupBy("vec_id").agg(F.min("weights").alias("weights"))


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of weights; shorter vectors have no weight in further dimensions."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Inner products of query rows with n candidates, one term after another."""
    total = np.zeros((len(queries), n), np.int64)
    for term, (rows, weights) in enumerate(postings[: queries.shape[1]]):
        asked = np.flatnonzero(queries[:, term])
        if not len(asked) or not len(rows):
            continue
        part = queries[asked, term][:, None] * weights[None, :]
        if len(rows) == n and len(asked) == len(queries):
            total += part
        else:
            total[np.ix_(asked, rows)] += part
    return total


def best(total: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the k highest allowed scores of each row; ties to the earlier candidate."""
    masked = np.where(allowed, total, np.iinfo(np.int64).min)
    n = masked.shape[1]
    if n > k:
        least = np.partition(masked, n - k, axis=1)[:, n - k]
        q, c = np.nonzero((masked >= least[:, None]) & allowed)
    else:
        q, c = np.nonzero(allowed)
    order = np.lexsort((c, -total[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, np.arange(len(masked)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], c[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query, by integer inner product.

    Both tables are (vec_id, weights).  A vector isn't compared with a query of the
    same vec_id.  Ties go to the smaller vec_id; a query with fewer than k others
    gets all of them; empty tables give no rows.
    """
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(0))).first()
    m = queries.count()
    schema = "query_id long, vec_id long, score long"
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    fit = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    # More blocks than memory asks for copy queries to more tasks; only as many as there are cores.
    blocks = max(math.ceil(n / min(CANDIDATE_BLOCK, fit)), min(math.ceil(n / 512), spark.sparkContext.defaultParallelism))
    groups = math.ceil(m / min(QUERY_BLOCK, fit))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("asked"), "vec_id", "weights")
    right = queries.select(every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("asked"), "vec_id", "weights")

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not candidates.num_rows or not asked.num_rows:
            return empty
        candidates = candidates.sort_by("vec_id")
        ids, matrix = candidates["vec_id"].to_numpy(), _matrix(candidates["weights"])
        names, rows = asked["vec_id"].to_numpy(), _matrix(asked["weights"])
        postings = []
        for term in range(matrix.shape[1]):
            there = np.flatnonzero(matrix[:, term])
            postings.append((there, np.ascontiguousarray(matrix[there, term])))
        out = []
        for i in range(0, len(rows), STRIP):
            part, name = rows[i : i + STRIP], names[i : i + STRIP]
            total = scores(part, postings, len(ids))
            q, c = best(total, k, name[:, None] != ids[None, :])
            out.append((name[q], ids[c], total[q, c]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    found = left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
