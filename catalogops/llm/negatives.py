"""Hard negatives by segment summaries that bound inner products.

Each vector is cut into segments, and of each its mean and deviation (the length of what is left
when the mean is taken off) are stored. Over one segment of n components the inner product of two
vectors is n times the product of their means, plus or minus at most the product of their
deviations. Sums over the segments bound the score from both sides. Segments are refined
hierarchically: the bounds of one segment, then of four, then of sixteen drop more and more rows,
and only what is left is scored exactly.

An anchor's positives are its best rows of its own label: a row whose upper bound is under the
least of the best lower bounds so far cannot be one. Its negatives are, for each positive, the best
rows of other labels whose score lies in a band under the positive's: rows whose bounds miss every
band, or are under the best that surely lie in it, cannot be one. Nothing that could be an answer is
dropped, so results are exact.

Rows are cut into shards of about ``SHARD_ROWS`` and anchors into blocks of ``ANCHOR_ROWS`` by
hashes, and every block meets every shard, so a task holds one of each however common a label or a
vector is; the work is anchors times rows, as the question is. The best of each shard are merged.

Nulls, ties, repeats: rows without id or label, null vectors and those with a null or non-finite
component take no part. Vectors meet those of their own length only; empty ones score 0. Of rows
that repeat an id, the one with the least label and vector takes part. Ties go to the smaller id.
An anchor without another row of its label has no positives and no row in the result, nor has a
positive without a row in its band. Components and scores are integers of 64 bits. Other columns
are not read. No rows give no rows.
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

# Segments at each refinement; a vector with fewer components has one segment for each.
LEVELS = (1, 4, 16)
SHARD_ROWS, ANCHOR_ROWS = 1 << 13, 1 << 10
# Anchors whose bounds are worked out together in a task.
TOGETHER = 64
POSITIVES, NEGATIVES = 5, 3
# A negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
POSITIVE = ("anchor_id", "positive_id", "positive_score")
NEGATIVE = (*POSITIVE, "negative_id", "negative_score")


def _finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector of the rows that take part; each component times ``scale``, floored."""
    told = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    told = told.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("vector")))
    return told.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("long")))


def cuts(size: int, segments: int) -> np.ndarray:
    """Where the segments of a vector start, and its end; as equal as can be."""
    segments = max(1, min(segments, size))
    return np.arange(segments + 1) * size // segments


def summaries(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments."""
    at = cuts(vectors.shape[1], segments)
    if vectors.shape[1] == 0:
        return np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1))
    lengths = np.diff(at)
    means = np.add.reduceat(vectors, at[:-1], axis=1) / lengths
    rest = vectors - np.repeat(means, lengths, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))


def summarised(rows: DataFrame) -> DataFrame:
    """The rows with size, means and deviations: those of all ``LEVELS``, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            means, deviations = [None] * batch.num_rows, [None] * batch.num_rows
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                flat = batch.column("vector").take(pa.array(own)).flatten().to_numpy().reshape(len(own), size).astype(np.float64)
                both = [summaries(flat, n) for n in LEVELS]
                for i, m, d in zip(own, np.hstack([b[0] for b in both]), np.hstack([b[1] for b in both]), strict=True):
                    means[i], deviations[i] = m, d
            made = [pa.array(x, pa.list_(pa.float64())) for x in (means, deviations)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "means", "deviations"])

    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("one")).select("vec_id", "one.label", "one.vector")
    sized = one.withColumn("size", F.size("vector"))
    return sized.mapInArrow(run, "vec_id long, label long, vector array<long>, size int, means array<double>, deviations array<double>")


class Side:
    """One shard's rows, or one block's anchors, as arrays."""

    def __init__(self, frame: pd.DataFrame):
        self.id, self.label = frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        self.vector = np.stack(frame["vector"]).astype(np.int64)
        size = self.vector.shape[1]
        parts = np.r_[0, np.cumsum([len(cuts(size, n)) - 1 for n in LEVELS])]
        means, deviations = np.stack(frame["means"]), np.stack(frame["deviations"])
        self.means = [means[:, a:b] for a, b in zip(parts[:-1], parts[1:], strict=True)]
        self.deviations = [deviations[:, a:b] for a, b in zip(parts[:-1], parts[1:], strict=True)]
        self.lengths = [np.maximum(np.diff(cuts(size, n)), 0) for n in LEVELS]
        self.norm = np.sqrt((self.vector.astype(np.float64) ** 2).sum(axis=1))


def bounds(anchors: Side, some: np.ndarray, rows: Side, left: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each (anchor, row), wide enough for rounding."""
    middle = (anchors.means[level][some] * anchors.lengths[level]) @ rows.means[level][left].T
    spread = anchors.deviations[level][some] @ rows.deviations[level][left].T
    spread += 1e-9 * np.outer(anchors.norm[some], rows.norm[left]) + 0.25
    return middle - spread, middle + spread


def exact(anchors: Side, i: int, rows: Side, at: np.ndarray) -> np.ndarray:
    """Integer inner products of one anchor with some rows."""
    return rows.vector[at] @ anchors.vector[i]


def _none(names: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def _scored(anchors: Side, rows: Side, wanted, useful) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores) after refining: ``wanted`` says which pairs are asked for at all,
    and ``useful`` which of them can still be an answer by their bounds."""
    for lo in range(0, len(anchors.id), TOGETHER):
        some = np.arange(lo, min(lo + TOGETHER, len(anchors.id)))
        left = np.arange(len(rows.id))
        live = wanted(some, left)
        for level in range(len(LEVELS)):
            low, high = bounds(anchors, some, rows, left, level)
            live &= useful(some, np.where(live, low, -np.inf), np.where(live, high, -np.inf))
            any_ = live.any(axis=0)
            left, live = left[any_], live[:, any_]
        for n, i in enumerate(some):
            at = left[live[n]]
            if len(at):
                yield i, at, exact(anchors, i, rows, at)


def best_positives(anchors: Side, rows: Side, k: int) -> pd.DataFrame:
    found = []
    same = lambda some, left: (anchors.label[some][:, None] == rows.label[left]) & (anchors.id[some][:, None] != rows.id[left])
    useful = lambda some, low, high: (high >= _kth(low, k)[:, None]) & (high > -np.inf)
    for i, at, score in _scored(anchors, rows, same, useful):
        best = np.lexsort((rows.id[at], -score))[:k]
        found.append(pd.DataFrame({"anchor_id": anchors.id[i], "positive_id": rows.id[at[best]], "positive_score": score[best]}))
    return pd.concat(found) if found else _none(POSITIVE)


def best_negatives(anchors: Side, positives: list, rows: Side, k: int, least: int, most: int) -> pd.DataFrame:
    """``positives`` has each anchor's (id, score)."""
    found = []
    # Integer ends of each band: the least and greatest score that the two conditions allow.
    bands = [[(-(-least * s // 100), most * s // 100) for _, s in own] for own in positives]
    width = max((len(b) for b in bands), default=0)
    ends = np.full((len(bands), width, 2), np.nan)
    for i, own in enumerate(bands):
        ends[i, : len(own)] = own

    def useful(some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(low.shape, bool)
        for b in range(width):
            first, last = ends[some, b, 0][:, None], ends[some, b, 1][:, None]
            sure = np.where((low >= first) & (high <= last), low, -np.inf)
            out |= (high >= np.maximum(first, _kth(sure, k)[:, None])) & (low <= last) & (high > -np.inf)
        return out

    other = lambda some, left: anchors.label[some][:, None] != rows.label[left]
    for i, at, score in _scored(anchors, rows, other, useful):
        order = np.lexsort((rows.id[at], -score))
        at, score = at[order], score[order]
        for (positive, own), (first, last) in zip(positives[i], bands[i], strict=True):
            best = np.flatnonzero((score >= first) & (score <= last))[:k]
            if len(best):
                found.append(
                    pd.DataFrame({"anchor_id": anchors.id[i], "positive_id": positive, "positive_score": own, "negative_id": rows.id[at[best]], "negative_score": score[best]})
                )
    return pd.concat(found) if found else _none(NEGATIVE)


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label, vector (array of long), as ``whole_numbers`` gives them; rows
    where ``anchor`` holds are anchors. A negative scores ``least`` to ``most`` hundredths of its
    positive.
    """
    rows = durable(summarised(vectors), "summaries")
    asked = rows.where(anchor)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // anchor_rows))
    # Both sides' numbers are of one type: equal numbers of different types hash apart.
    number = lambda n, *salt: F.pmod(F.xxhash64("vec_id", *salt), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A salt of its own for the blocks, since shards and blocks come from one hash.
    block = number(blocks, F.lit("block"))
    left = rows.select("*", number(shards).alias("shard")).select("*", every(blocks).alias("block"))

    def meet(right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
        # Named anew, since both sides come from one table.
        spread = right.select(*(F.col(c).alias(c) for c in right.columns), block.alias("block")).select("*", every(shards).alias("shard"))
        return left.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, schema)

    def find_positives(shard: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if len(shard) == 0 or len(some) == 0:
            return _none(POSITIVE)
        return best_positives(Side(some), Side(shard), positives)

    def find_negatives(shard: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if len(shard) == 0 or len(some) == 0:
            return _none(NEGATIVE)
        own = [[(int(p["positive_id"]), int(p["positive_score"])) for p in x] for x in some["positives"]]
        return best_negatives(Side(some), own, Side(shard), negatives, least, most)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = meet(asked, ["size", "label", "shard", "block"], find_positives, ", ".join(f"{n} long" for n in POSITIVE))
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
    lists = durable(found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")
    found = meet(
        asked.join(lists, "vec_id"), ["size", "shard", "block"], find_negatives,
        ", ".join(f"{n} long" for n in NEGATIVE),
    )
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query(
    "op11_segment_hard_negatives",
    """
    WITH rows_ AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vector
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
    ), scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.vector, b.vector) AS BIGINT) AS score
      FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
      other_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """,
)
def op11_segment_hard_negatives(spark, sf_dir):
    """Three hard negatives for each of the five best positives of every fiftieth vector."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
