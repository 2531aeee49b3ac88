"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of sign bits of random projections; near vectors share
long prefixes. The table is cut into shards of about ``SHARD_ROWS`` rows by a hash of the id, and in
a shard each tree is the sorted array of its strings. A query descends every tree to its longest
matching prefix; then all trees ascend together, one bit at a time, until their prefix ranges hold
``ASCENT`` times the shard's rows in all (ranges of different trees overlap), and further if those are
fewer than ``k`` different candidates, up to the root, where all rows are. Whatever lies in a
range is measured exactly, and the nearest of each shard are merged.

Ranges are taken whole, so vectors that are equal, and so have equal strings, are found together
however many there are; they spread evenly over the shards. A task holds one shard and one block of
``QUERY_ROWS`` queries. Projections are fitted on at most ``SAMPLE`` rows (mean and covariance), and
every row is indexed.

On vectors without structure, a neighbour shares little more of a prefix than any row, and good
recall takes a large share of all rows; ``ASCENT`` is set for that.

Nulls, ties, repeats: vectors that are null, empty, all zero or hold null or non-finite components
are neither queries nor candidates, nor are rows without id. Vectors meet only those of their own
length. Ties go to the smaller id. A query's own id is never its neighbour; an id with several
vectors is one candidate, as near as the nearest of them. Fewer candidates than ``k`` are all
returned. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.registry import query, table
from catalogops.plans.durable import durable

TREES, BITS = 24, 64
SHARD_ROWS, QUERY_ROWS = 1 << 15, 1 << 12
SAMPLE = 4096
ASCENT = 1.2
K = 10


def usable(vector: Column) -> Column:
    """Whether the vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def projections(size: int, sample: np.ndarray, trees: int = TREES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean to take off, and (size, trees * BITS) directions, denser where the sample spreads more."""
    drawn = np.random.default_rng(seed).normal(size=(size, trees * BITS))
    if len(sample) < 2 * size:
        return (sample.mean(axis=0) if len(sample) else np.zeros(size)), drawn
    values, vectors = np.linalg.eigh(np.cov(sample.T).reshape(size, size))
    return sample.mean(axis=0), (vectors * np.sqrt(np.maximum(values, 0))) @ drawn


def index(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """vec_id, embedding (doubles), size, strings: one 64-bit hash string of each tree."""
    rows = (
        vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .withColumn("size", F.size("embedding"))
    )
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").collect()
    by_size: dict[int, list] = {}
    for (vector,) in sample:
        by_size.setdefault(len(vector), []).append(vector)
    fitted = {n: projections(n, np.array(x), trees) for n, x in by_size.items()}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.uint64)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            made = np.zeros((batch.num_rows, trees), np.uint64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                mean, directions = fitted.get(int(size)) or projections(int(size), np.zeros((0, size)), trees)
                flat = batch.column("embedding").take(pa.array(own)).flatten().to_numpy().reshape(-1, size)
                for tree in range(trees):
                    bits = (flat - mean) @ directions[:, tree * BITS : (tree + 1) * BITS] > 0
                    made[own, tree] = (bits * weights).sum(axis=1)
            ends = np.arange(0, made.size + 1, trees, dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, made.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "strings"])

    return rows.mapInArrow(strings, "vec_id long, embedding array<double>, size int, strings array<long>")


def ranges(sorted_strings: np.ndarray, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows lie that share the first ``depth`` bits with each asked string."""
    free = np.uint64((1 << (BITS - depth)) - 1)
    low = asked & ~free
    return np.searchsorted(sorted_strings, low, "left"), np.searchsorted(sorted_strings, low | free, "right")


def forest_search(ids: np.ndarray, vectors: np.ndarray, strings: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, q_strings: np.ndarray, k: int = K, ascent: float = ASCENT) -> pd.DataFrame:
    """query_id, vec_id, score of the ``k`` nearest found of each query in one shard."""
    trees = strings.shape[1]
    order = np.argsort(strings, axis=0, kind="stable")
    ordered = np.take_along_axis(strings, order, axis=0)
    want = min(max(ascent * len(ids), 4 * k), trees * len(ids))
    depth = np.full(len(q_ids), -1)
    for level in range(BITS, -1, -1):
        # Synchronous ascent: queries that have too few rows go up by one bit in all trees.
        open_ = np.flatnonzero(depth < 0)
        if len(open_) == 0:
            break
        total = np.zeros(len(open_), np.int64)
        for tree in range(trees):
            lo, hi = ranges(ordered[:, tree], q_strings[open_, tree], level)
            total += hi - lo
        depth[open_[total >= want]] = level
    bounds = np.zeros((2, trees, len(q_ids)), np.int64)
    for level in np.unique(depth):
        own = np.flatnonzero(depth == level)
        for tree in range(trees):
            bounds[:, tree, own] = ranges(ordered[:, tree], q_strings[own, tree], int(level))
    once = len(np.unique(ids)) == len(ids)
    found = []
    for i in range(len(q_ids)):
        at = _reached(ids, order, bounds[:, :, i], q_ids[i])
        while depth[i] > 0 and (len(at) if once else len(np.unique(ids[at]))) < k:
            # Ranges overlap, so they may hold fewer rows than ``want``: go on up, to all rows if need be.
            depth[i] -= 1
            for tree in range(trees):
                bounds[:, tree, i] = np.ravel(ranges(ordered[:, tree], q_strings[i : i + 1, tree], int(depth[i])))
            at = _reached(ids, order, bounds[:, :, i], q_ids[i])
        score = np.sqrt(((vectors[at] - q_vectors[i]) ** 2).sum(axis=1))
        if once and len(at) > k:
            within = score <= np.partition(score, k - 1)[k - 1]
            at, score = at[within], score[within]
        best = np.lexsort((ids[at], score))
        if not once:
            best = best[np.sort(np.unique(ids[at[best]], return_index=True)[1])]
        best = best[:k]
        found.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[at[best]], "score": score[best]}))
    return pd.concat(found, ignore_index=True)


def _reached(ids: np.ndarray, order: np.ndarray, bounds: np.ndarray, own: int) -> np.ndarray:
    """Distinct rows in one query's ranges of all trees, without those of its own id."""
    near = np.zeros(len(ids), bool)
    for tree in range(order.shape[1]):
        near[order[bounds[0, tree] : bounds[1, tree], tree]] = True
    near &= ids != own
    return np.flatnonzero(near)


def search(
    indexed: DataFrame, queries: DataFrame, k: int = K, ascent: float = ASCENT, *, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score; both frames are rows of ``index``."""
    rows = durable(indexed.dropDuplicates(["vec_id", "embedding"]), "forest")
    asked = durable(queries.dropDuplicates(["vec_id", "embedding"]), "asked")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    # Both sides' numbers are of one type: equal numbers of different types hash apart.
    number = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", number(shards).alias("shard")).select("*", every(blocks).alias("block"))
    right = asked.select("*", number(blocks).alias("block")).select("*", every(shards).alias("shard"))
    keys = ["size", "shard", "block"]

    def arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return frame["vec_id"].to_numpy(), np.stack(frame["embedding"]).astype(np.float64), np.stack(frame["strings"]).view(np.uint64)

    def meet(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if len(shard) == 0 or len(block) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return forest_search(*arrays(shard), *arrays(block), k=k, ascent=ascent)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    # An id with several vectors counts with the nearest.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op3_hash_prefix_forest")
def op3_hash_prefix_forest(spark, sf_dir):
    """The ten nearest vectors of every hundredth one."""
    indexed = durable(index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "index")
    return search(indexed, indexed.where("vec_id % 100 = 0"))
