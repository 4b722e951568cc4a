"""Exact top-k by inner product with the threshold algorithm.

Candidates are dealt into blocks of bounded size.  A block sorts its vectors once per dimension; a query walks the lists of
its non-zero dimensions from the best end, all to the same depth, scores every vector it meets there, and stops when the
scores of the last places seen, added up, are below its k-th result.  Results of the blocks are merged.  Queries come in
blocks as well, so a task holds one block of each, whatever the size of the table; only k rows per query and block leave it.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; equal rows
count once; a query does not find rows with its own id; vectors meet those of their length only; ties go to the smaller
id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

K = 5
BLOCK = 16_384
QUERY_BLOCK = 1024
STEP = 4


def threshold(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int = K) -> tuple[list[tuple[int, int]], int]:
    """The best (score, id) of a block for one query, and the depth at which it stopped.

    ``lists`` has the vectors' numbers in rising order of each dimension, a row per dimension.
    """
    n = len(ids)
    active = np.flatnonzero(query)
    weight = query[active]
    met = ids == own
    scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(active):  # all scores are zero: ids decide
        rest = np.sort(ids[~met])[:k]
        return [(0, int(i)) for i in rest], 0
    up = weight > 0
    rising, falling = active[up], active[~up]
    depth, step = 0, STEP
    while depth < n:
        stop = min(n, depth + step)
        # only this step's stretch of each list is copied
        rows = np.concatenate([lists[rising, n - stop:n - depth].ravel(), lists[falling, depth:stop].ravel()])
        fresh = np.unique(rows[~met[rows]])
        met[fresh] = True
        scores, found = np.concatenate([scores, vectors[fresh] @ query]), np.concatenate([found, ids[fresh]])
        order = np.lexsort((found, -scores))[:k]
        scores, found = scores[order], found[order]
        last = np.where(up, lists[active, n - stop], lists[active, stop - 1])
        if len(scores) == k and int(scores[-1]) > int(vectors[last, active] @ weight):
            depth = stop
            break
        depth, step = stop, step * 2
    return [(int(s), int(i)) for s, i in zip(scores, found, strict=True)], depth


def _task(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            vectors = np.stack(candidates["v"].to_numpy()).astype(np.int64)
            ids = candidates["id"].to_numpy(np.int64)
            lists = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32).copy()
            for own, vector in zip(queries["id"].tolist(), queries["v"], strict=True):
                best, _ = threshold(vectors, ids, lists, np.asarray(vector, np.int64), own, k)
                out += [(own, i, s) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector takes no part."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows that ``is_query`` marks, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))
    n, asked = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long"))).first()
    blocks = max(-(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    query_blocks = max(-(-(asked or 0) // query_block), 1)
    deal = lambda size: F.pmod(F.xxhash64("id", "v"), F.lit(size)).cast("int")
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    candidates = rows.select("id", "v", "dim", deal(blocks).alias("cb"), spread(query_blocks).alias("qb"))
    queries = rows.filter("q").select("id", "v", "dim", spread(blocks).alias("cb"), deal(query_blocks).alias("qb"))
    keys = ["dim", "cb", "qb"]
    near = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_task(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
