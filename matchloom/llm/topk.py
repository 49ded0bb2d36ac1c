"""Exact top-k inner products with MaxScore.

Components of a query are its terms, and each dimension's column of candidate values is a term's posting list. Candidates
are dealt into shards and queries into blocks. In each cell of a shard and a block every query splits its terms by score
bounds into essential and non-essential ones: only the lists of essential terms are traversed, and the others are probed,
largest bound first, only for candidates that can still reach the k-th best score. A first round searches one shard; its
k-th best score of each query is a threshold that all other shards start from. Shards are merged by a window over k rows a
shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.llm.common import counted_stage, stage

#: Vector components in a shard or in a block of queries, and candidates in a shard at least.
CELL = 4_000_000
LEAST_SHARD = 4_096
_PART = 2_048
#: The bound that non-essential terms may use up. Any share up to 1 is exact; where vectors are dense, most terms would pass
#: the whole bound and every candidate would be probed.
SPLIT = 1 / 8
_EXACT = 2**62


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, bad), F.lit(False))


def integers(vector: str, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(sizes), width), np.int64), 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


class Lists:
    """A shard's posting lists: a row of candidate values for each term, in parts that are contiguous, and their bounds."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, part: int = _PART):
        """``ids`` ascend; ``values`` has a row for each candidate."""
        self.terms = values.shape[1]
        self.parts = [(ids[at : at + part], np.ascontiguousarray(values[at : at + part].T)) for at in range(0, len(ids), part)]
        self.high, self.low = values.max(axis=0), values.min(axis=0)


def search(lists: Lists, query_id: int, query: np.ndarray, k: int, least: float = -np.inf, work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best candidates of a shard for a query by score, ties to the smaller id; none below ``least``.

    The query's own id is left out. ``work`` gets the numbers of list entries that were traversed, probed and there.
    """
    most, worst = np.maximum(query * lists.high, query * lists.low), np.minimum(query * lists.high, query * lists.low)
    order = np.argsort(most - worst, kind="stable")
    spread = np.cumsum((most - worst)[order])
    # Bounds of what the first n terms of the order can add.
    can, must = np.r_[0, np.cumsum(most[order])], np.r_[0, np.cumsum(worst[order])]
    best_s, best_i = np.zeros(0, query.dtype), np.zeros(0, np.int64)
    for own, part in lists.parts:
        theta = max(least, best_s[-1]) if len(best_s) == k else least
        n = int(np.searchsorted(spread, (theta - must[-1]) * SPLIT)) if theta > -np.inf else 0
        weak, strong = order[:n], order[n:]
        score = query[strong] @ part.take(strong, axis=0)
        mine = int(np.searchsorted(own, query_id, side="right") - np.searchsorted(own, query_id))
        if n and len(own) >= k + mine:
            # Rows of the query's own id may be among the best of the part, so as many more are asked for.
            theta = max(theta, np.partition(score, -k - mine)[-k - mine] + must[n])
        c = np.flatnonzero(score >= theta - can[n])
        if mine:
            c = c[own[c] != query_id]
        if work is not None:
            work["there"] += part.size
            work["traversed"] += len(strong) * len(own)
        got = score[c]
        for t in range(n - 1, -1, -1):
            if work is not None:
                work["probed"] += len(c)
            got = got + query[weak[t]] * part[weak[t], c]
            live = got + can[t] >= theta
            c, got = c[live], got[live]
        if len(best_s) == k:
            live = got >= best_s[-1]
            c, got = c[live], got[live]
        if len(c):
            s, i = np.r_[best_s, got], np.r_[best_i, own[c]]
            by = np.lexsort((i, -s))[:k]
            best_s, best_i = s[by], i[by]
    keep = best_s >= least
    return best_i[keep], best_s[keep]


def top_k(rows: DataFrame, is_query: Column, k: int = 20, cell: int = CELL, least_shard: int = LEAST_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of other ids with the highest integer inner products.

    ``rows`` has vec_id and vector (array of long without nulls; null vectors are left out); other columns are not read.
    Shorter and empty vectors count as padded with zeros. Queries and candidates are any rows; a repeated vec_id asks once,
    by its smallest vector, and each of its rows is a candidate. Rows without an id take no part. No query, or no candidate,
    gives no row. Scores are exact 64-bit integers; where a sum could pass 2^62 it raises OverflowError instead.
    """
    rows = stage(rows.where("vec_id is not null and vector is not null").select("vec_id", "vector"), "vectors")
    asked, m = counted_stage(stage(rows.where(is_query), "asking").groupBy("vec_id").agg(F.min("vector").alias("vector")), "asked")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    none = rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    if not m:
        return none
    width = max(1, n["width"])
    # As few copies of a vector as cells allow that fit in memory, but enough shards for all cores.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = -(-m * width // cell)
    shards = max(-(-n["n"] * width // cell), min(-(-cores // blocks), n["n"] // least_shard), 1)
    deal = lambda of, salt: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = rows.withColumn("s", deal(shards, 1))
    asking = asked.withColumn("b", deal(blocks, 2))

    def found(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        left = candidates.withColumn("b", each(blocks)).groupBy("s", "b")
        right = queries.groupBy("s", "b")
        return left.cogroup(right).applyInArrow(_cell(width, k), "query_id long, vec_id long, score long")

    unknown = F.lit(None).cast("long")
    first = found(dealt.where("s = 0"), asking.select("vec_id", "vector", unknown.alias("least"), F.lit(0).alias("s"), "b"))
    if shards > 1:
        first = stage(first, "first")
        least = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        # A query that found fewer than k has no threshold yet.
        least = least.select("vec_id", F.when(F.col("n") == k, F.col("least")).alias("least"))
        others = asking.join(least, "vec_id", "left").withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        first = first.unionByName(found(dealt.where("s > 0"), others.select("vec_id", "vector", "least", "s", "b")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cell(width: int, k: int):
    def cell(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if candidates.num_rows and queries.num_rows:
            ids = candidates.column("vec_id").to_numpy()
            values, asks = _matrix(candidates.column("vector"), width), _matrix(queries.column("vector"), width)
            bound = _largest(values) * _largest(asks) * width
            if bound >= _EXACT:
                raise OverflowError(f"inner products of up to {bound} can't be held exactly in 64 bits")
            # Sums of whole numbers below 2^24 and 2^52 are exact in floating point.
            kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**51 else np.int64
            order = np.argsort(ids, kind="stable")
            lists, asks = Lists(ids[order], values[order].astype(kind)), asks.astype(kind)
            for i, q in enumerate(queries.column("vec_id").to_pylist()):
                least = queries.column("least")[i].as_py()
                got, score = search(lists, q, asks[i], k, -np.inf if least is None else least)
                for to, x in zip(out, (np.full(len(got), q), got, score.astype(np.int64))):
                    to.append(x)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out))))

    return cell


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))
