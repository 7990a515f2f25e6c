"""Exact top-k search by distributed histogram selection (operator 6).

Vectors are turned into integers; blocks of queries meet blocks of candidates, and
all inner products are computed. Passes over the scores refine, for each query, a
histogram of its scores: the bin that holds the k-th largest score becomes the next
pass's range, until a bin is one score wide. The last pass keeps the scores above the
k-th value and fills up with those equal to it, smallest vec_id first.

A block needs to count a query's k largest scores in the range only: what lies below
them can't be the k-th value. So each pass sends at most k counts a query and block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerocast.llm.common import written

#: Queries and candidates of a block; log2 of the bins of a histogram.
QUERY_BLOCK, CANDIDATE_BLOCK, BIN_BITS = 1024, 4096, 10
SCALE = 256.0


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", repeats: bool = False) -> DataFrame:
    """(vec_id, vec array<long>): floor(256 * x) of each component; without rows that are null or hold null or
    non-finite components, without null ids; equal rows once, or all of them with ``repeats``."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = (embeddings.filter(F.col(id_col).isNotNull() & x.isNotNull() & good & (F.size(x) > 0))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("vec")))
    return rows if repeats else rows.distinct()


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), -1)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if top < 2.0**53:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    return queries @ candidates.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k candidates with the largest integer inner products of each query.

    Both inputs have vec_id and vec (see integer_vectors). Candidates of a query are all rows
    of ``vectors`` of the same length and another vec_id. Result: query_id, rank (int, from
    1), vec_id, score (long); ties go to the smaller vec_id; a query with fewer candidates
    returns all of them. Of queries that repeat an id the smallest vector counts; vectors
    that repeat an id, with whatever content, are candidates of their own. Products must fit
    64 bits. Empty inputs give an empty result.
    """
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    vectors, queries = written(vectors, "vectors"), written(queries, "queries")
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).first() for df in (queries, vectors)]
    n_q, n_c = (max(1, -(-s["n"] // b)) for s, b in zip(sizes, (QUERY_BLOCK, CANDIDATE_BLOCK), strict=True))
    reach = int(math.sqrt((sizes[0]["top"] or 0.0) * (sizes[1]["top"] or 0.0)) * (1 + 1e-9)) + 1
    bits = (2 * reach).bit_length()
    cell = ["qb", "cb", "dim"]
    dim = F.size("vec").alias("dim")
    right = (vectors.select("vec_id", "vec", dim, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_c)).alias("cb"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("qb", "cb", "dim", "vec_id", "vec"))

    def blocks(state: DataFrame) -> DataFrame:
        return (state.withColumn("dim", dim).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int"))
                .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
                .select(F.col("qb").alias("q"), F.col("cb").alias("c"), F.col("dim").alias("d"), "vec_id", "vec", "bin", "need"))

    def offsets(left: pa.Table, right: pa.Table):
        """By parts of the queries: rows, candidate ids, scores + reach (-1: no candidate)."""
        ids, found = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
        q, c = _matrix(left.column("vec")), _matrix(right.column("vec"))
        for at in range(0, len(ids), 128):
            o = _scores(q[at:at + 128], c) + reach
            o[ids[at:at + 128, None] == found[None, :]] = -1
            yield slice(at, min(at + 128, len(ids))), found, o

    def counting(shift: int, before: int | None):
        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            query, bins, n = [], [], []
            if left.num_rows and right.num_rows:
                ids, inside = np.asarray(left.column("vec_id")), np.asarray(left.column("bin"))
                for rows, _, o in offsets(left, right):
                    if before is not None:
                        o = np.where(o >> before == inside[rows, None], o, -1)
                    if o.shape[1] > k:
                        o = np.partition(o, o.shape[1] - k, axis=1)[:, -k:]
                    row, at = np.nonzero(o >= 0)
                    key, times = np.unique(np.stack((row, o[row, at] >> shift)), axis=1, return_counts=True)
                    query.append(ids[rows][key[0]])
                    bins.append(key[1])
                    n.append(times)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
            return pa.table({"vec_id": join(query), "found": join(bins), "n": join(n)})
        return count

    state = queries.select("vec_id", "vec", F.lit(0).cast("long").alias("bin"), F.lit(k).cast("long").alias("need"))
    before, shift = None, max(0, bits - BIN_BITS)
    while True:
        counts = (blocks(state).groupBy("q", "c", "d").cogroup(right.groupBy(*cell))
                  .applyInArrow(counting(shift, before), "vec_id long, found long, n long")
                  .groupBy("vec_id", "found").agg(F.sum("n").alias("n")))
        down = Window.partitionBy("vec_id").orderBy(F.desc("found"))
        counts = counts.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # the highest bin with which the need is met; if there are fewer scores, the lowest one
        placed = (counts.join(state.select("vec_id", "need"), "vec_id")
                  .groupBy("vec_id").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("found", (F.col("upto") - F.col("n")).alias("above")))).alias("hit"),
                                         F.min(F.struct("found", (F.col("upto") - F.col("n")).alias("above"))).alias("low")))
        state = (state.join(placed.withColumn("hit", F.coalesce("hit", "low")), "vec_id")
                 .select("vec_id", "vec", F.col("hit.found").alias("bin"), (F.col("need") - F.col("hit.above")).alias("need")))
        state = written(state, "ranges")
        if shift == 0:
            break
        before, shift = shift, max(0, shift - BIN_BITS)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        query, found, score = [], [], []
        if left.num_rows and right.num_rows:
            ids, kth, need = (np.asarray(left.column(c)) for c in ("vec_id", "bin", "need"))
            for rows, candidates, o in offsets(left, right):
                for i in np.flatnonzero((o >= kth[rows, None]).any(axis=1)).tolist():
                    r = rows.start + i
                    over, even = np.flatnonzero(o[i] > kth[r]), np.flatnonzero(o[i] == kth[r])
                    # of the ties the smallest ids; more than are needed can't be in the result
                    even = even[np.argsort(candidates[even], kind="stable")[:need[r]]]
                    at = np.concatenate((over, even))
                    query.append(np.full(len(at), ids[r]))
                    found.append(candidates[at])
                    score.append(o[i, at] - reach)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.table({"query_id": join(query), "vec_id": join(found), "score": join(score)})

    hits = (blocks(state).groupBy("q", "c", "d").cogroup(right.groupBy(*cell))
            .applyInArrow(last, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
