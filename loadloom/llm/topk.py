"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into integers. Blocks of neighbouring ids keep the largest and smallest value
of every component; with them a query gets an upper bound for each block. Blocks are visited by
falling bound and scored through their forward index (the block's rows), until the next bound
lies below the k-th score. Vectors are dealt into shards of bounded size and queries into chunks; each
pair of a shard and a chunk is one group, and its k best rows per query are merged.

Defined results: rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part. Missing components of a shorter vector count as 0. Rows that repeat an id are
candidates of their own, but no row is a candidate for a query of its own id; of several query rows with one
id the smallest vector asks. Scores beyond 64 bits stop at its ends. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SCALE = 1024
BLOCK = 256
#: Components in a shard of vectors and in a chunk of queries at most, about.
SHARD_VALUES = 4 << 20
CHUNK_VALUES = 1 << 20
#: Blocks scored between two looks at the bounds.
ROUND = 4


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): usable rows, components as floor(1024 x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf))
    return vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
            "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def _fits(q: np.ndarray, v: np.ndarray):
    """Number type in which all inner products of the two are exact."""
    most = int(np.abs(q.astype(object)).max(initial=0)) * int(np.abs(v.astype(object)).max(initial=0)) * v.shape[1] \
        if max(abs(int(q.min(initial=0))), abs(int(v.min(initial=0)))) == 1 << 63 else \
        int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * v.shape[1]
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """(query, score, id) of each query's k best rows; also the number of blocks scored."""
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    kind = _fits(q, v)
    q, v = q.astype(kind), v.astype(kind)
    begins = np.arange(0, len(ids), BLOCK)
    top, low = np.maximum.reduceat(v, begins), np.minimum.reduceat(v, begins)
    out, visited = [], 0
    for i in range(len(q_ids)):
        plus, minus = np.maximum(q[i], 0), np.minimum(q[i], 0)
        bound = top @ plus + low @ minus
        visit = np.argsort(-bound, kind="stable")
        best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
        for at in range(0, len(visit), ROUND):
            some = visit[at:at + ROUND]
            if len(best_s) == k:
                some = some[bound[some] >= best_s[-1]]
                if not len(some):
                    break
            rows = np.concatenate([np.arange(b * BLOCK, min((b + 1) * BLOCK, len(ids))) for b in some.tolist()])
            visited += len(some)
            s, r = v[rows] @ q[i], ids[rows]
            good = r != q_ids[i]
            if len(best_s) == k:
                good &= s >= best_s[-1]
            s, r = np.concatenate([best_s, s[good]]), np.concatenate([best_i, r[good]])
            keep = np.lexsort((r, -s))[:k] if kind is not object else np.array(
                sorted(range(len(s)), key=lambda j: (-s[j], r[j]))[:k], np.int64)
            best_s, best_i = s[keep], r[keep]
        out += [(int(q_ids[i]), max(-1 << 63, min((1 << 63) - 1, int(s))), int(r)) for s, r in zip(best_s, best_i)]
    return out, visited


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as ``integers`` gives them."""
    total = lambda df: int(df.agg(F.sum(F.size("v") + 1)).first()[0] or 0)
    shards = max(1, -(-total(vectors) // SHARD_VALUES))
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    chunks = max(1, -(-total(asked.withColumnRenamed("q", "v")) // CHUNK_VALUES))
    # Rows, not ids, are dealt out, so that repeated ids do not meet in one shard.
    left = vectors.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    right = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if a.num_rows and b.num_rows:
            rows, _ = search(b["query_id"].to_numpy(), _matrix(b["q"]), a["vec_id"].to_numpy(), _matrix(a["v"]), k)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                        names=["query_id", "score", "vec_id"])

    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(
        tile, "query_id long, score long, vec_id long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
