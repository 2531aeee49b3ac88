"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of n-grams, hashed to ``2**BITS``: one to three consecutive token shapes
(case of a word, a punctuation run itself, whether the word repeats the one before) and one or two
consecutive lower-cased words. Class counts of every indicator come from all labelled rows that may
be learned from; their log-count ratios scale the indicators. On a sample bounded by ``SAMPLE`` the
linear hinge-loss model is fitted by dual coordinate descent, one coordinate (document) at a time,
and the margin is turned into a probability on a fifth of the sample that the fit has not seen.

Nulls, ties, repeats: a null or empty text has no indicators and scores the bias alone. Labels of a
document that has several are averaged, a tie counts as quality 1; null labels are left out. Rows
without an id are scored but never learned from. With no labelled rows, or rows of one class only,
every score is that class's share (0.5 without rows). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.registry import extended, free, held_out, query, remainder, table
from catalogops.llm.textbytes import IS_LOWER, IS_SPACE, IS_UPPER, IS_WORD, LOWER, grams, mix, packed, runs, slices, text_bytes, unpacked
from catalogops.plans.durable import durable

BITS = 18
# Bound of the rows that the hinge-loss model is fitted on; counts use all rows.
SAMPLE = 8000
ROUNDS = 12
COST = 0.1
SMOOTHING = 1.0
THRESHOLD = 0.3


def indicators(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) of each text, sorted."""
    kind = np.where(IS_SPACE[data], 0, np.where(IS_WORD[data], 1, 2)).astype(np.uint8)
    run = runs(data, offsets, kind, LOWER[data])
    if len(run.start) == 0:
        return run.doc, run.doc
    is_word = kind[run.start] == 1
    counted = lambda mask: np.r_[0, np.cumsum(mask[data])]
    upper, lower = counted(IS_UPPER), counted(IS_LOWER)
    n_upper, n_lower = upper[run.end] - upper[run.start], lower[run.end] - lower[run.start]
    case = np.where(n_upper == 0, 1, np.where(n_lower > 0, 2, np.where(n_upper == 1, 3, 4)))
    case = np.where(n_upper + n_lower == 0, 5, case)
    same = np.zeros(len(run.start), bool)
    words = np.flatnonzero(is_word)
    same[words[1:]] = (run.hash[words[1:]] == run.hash[words[:-1]]) & (run.doc[words[1:]] == run.doc[words[:-1]])
    shape = np.where(is_word, mix((case + 8 * same).astype(np.uint64)), run.hash)
    found = []
    for n in (1, 2, 3):
        found.append(grams(mix(shape + np.uint64(n)), run.doc, n))
    for n in (1, 2):
        found.append(grams(mix(run.hash[words] + np.uint64(16 + n)), run.doc[words], n))
    doc = np.concatenate([d for _, d in found])
    feature = np.concatenate([(h >> np.uint64(64 - bits)).astype(np.int64) for h, _ in found])
    both = np.unique((doc << bits) | feature)
    return both >> bits, both & ((1 << bits) - 1)


def _per_slice(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in slices(offsets):
        yield lo, hi, *indicators(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's rows by feature and class, and the indicators of the sampled rows."""
    schema = pa.schema([("feature", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64()), ("label", pa.int32()), ("place", pa.int64()), ("indicators", pa.binary())])
    counts = np.zeros((2, 1 << BITS), np.int64)
    none = lambda n, kind: pa.nulls(n, kind)
    # Rows that repeat an id give one row to fit from each task.
    given: set[int] = set()
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        sampled = batch.column("sampled").to_numpy(zero_copy_only=False)
        place = batch.column("place").to_numpy(zero_copy_only=False)
        for lo, hi, doc, feature in _per_slice(batch):
            own = label[lo:hi][doc]
            for c in (0, 1):
                np.add.at(counts[c], feature[own == c], 1)
            at = np.searchsorted(doc, np.arange(hi - lo + 1))
            picked = []
            for i in np.flatnonzero(sampled[lo:hi]).tolist():
                if int(place[lo + i]) not in given:
                    given.add(int(place[lo + i]))
                    picked.append(i)
            if picked:
                k = len(picked)
                yield pa.RecordBatch.from_arrays(
                    [
                        none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int64()),
                        pa.array([int(label[lo + i]) for i in picked], pa.int32()), pa.array([int(place[lo + i]) for i in picked], pa.int64()),
                        pa.array([feature[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in picked], pa.binary()),
                    ],
                    schema=schema,
                )
    seen = np.flatnonzero(counts.sum(axis=0))
    if len(seen):
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen]), none(len(seen), pa.int32()), none(len(seen), pa.int64()), none(len(seen), pa.binary())],
            schema=schema,
        )


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the L1-loss linear SVM over indicator rows scaled by ``scale``; the last is the bias.

    Each step solves one document's dual variable exactly, with its bounds 0 and ``cost``.
    """
    weights = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([(scale[r] ** 2).sum() + 1.0 for r in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            row, own = rows[i], scale[rows[i]]
            gradient = y[i] * (weights[row] @ own + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[row] += step * own
                weights[-1] += step
                alpha[i] = new
    return weights


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities (Newton's steps)."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * margin).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(slope), 1e-3), float(shift)


def _learn_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_learn`` on packed texts."""
    return _learn(unpacked(batches, ["label", "place", "sampled"]))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weight of each feature, and the bias, on the log-odds scale; at most ``sample`` rows are fitted.

    Of rows that repeat an id, one is fitted (the least by its indicators), and all are counted. Only rows whose id is not in the held-out fifth are learned from.
    """
    spark = documents.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder() != 0))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    known = durable(known, "labels")
    cut = known.orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    if cut is None:
        return np.zeros(1 << BITS), 0.0
    # Where labels are too many to be broadcast, texts are sent to them, and are most of what the fit keeps on disk.
    texts = documents.where(remainder() != 0).select("doc_id", "text")
    frames = texts.mapInArrow(packed("doc_id"), extended(texts.select("doc_id"), size="long", packed="binary"))
    rows = frames.join(known, "doc_id").select("size", "packed", "label", "place", (F.col("place") <= F.lit(cut)).alias("sampled"))
    learned = durable(rows.mapInArrow(_learn_packed, "feature long, n0 long, n1 long, label int, place long, indicators binary"), "learned")
    counts = learned.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    share = known.agg(F.sum(F.lit(1) - F.col("label")), F.sum("label")).first()
    if 0 in (share[0], share[1]):
        return np.zeros(1 << BITS), 30.0 if share[1] else -30.0
    total = np.zeros((2, 1 << BITS))
    total[0, counts["feature"]], total[1, counts["feature"]] = counts["n0"], counts["n1"]
    good, bad = total[1] + SMOOTHING, total[0] + SMOOTHING
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "label"], kind="stable")
        rows = [np.frombuffer(x, np.int32) for x in frame["indicators"]]
        y = np.where(frame["label"] == 1, 1.0, -1.0)
        # Long texts would drown short ones: every row is scaled to length 1 by its own norm.
        check = np.arange(len(rows)) % 5 == 0
        if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
            check = np.zeros(len(rows), bool) | (len(set(y)) < 2)
        weights = dual_coordinate_descent([r for r, c in zip(rows, check, strict=True) if not c], y[~check], ratio)
        seen = check if check.any() else ~check
        margin = np.array([(weights[r] * ratio[r]).sum() + weights[-1] for r, c in zip(rows, seen, strict=True) if c])
        slope, shift = _calibrated(margin, y[seen])
        used = np.flatnonzero(weights[:-1])
        return pd.DataFrame({"feature": np.r_[used, -1], "weight": np.r_[weights[used] * ratio[used] * slope, weights[-1] * slope + shift]})

    # One row an id, so at most ``sample`` rows, and one task may hold them.
    fitted = learned.where("feature IS NULL").groupBy("place").agg(F.min(F.struct("label", "indicators")).alias("one"))
    found = fitted.select("one.label", "place", "one.indicators", F.lit(0).alias("all")).groupBy("all").applyInPandas(model, "feature long, weight double").toPandas()
    weights = np.zeros(1 << BITS)
    if len(found) == 0:
        return weights, float(np.log(share[1] / share[0]))
    at = found["feature"] >= 0
    weights[found["feature"][at]] = found["weight"][at]
    return weights, float(found["weight"][~at].iloc[0])


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The columns of ``documents`` and quality_score, a probability; the model has a fixed size.

    If a given column has that name, underscores are appended to ours.
    """
    weights, bias = model[0].astype(np.float32), model[1]
    names = list(documents.columns)
    made = free(["quality_score"], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.full(batch.num_rows, bias)
            for lo, hi, doc, feature in _per_slice(batch):
                margin[lo:hi] += np.bincount(doc, weights[feature], minlength=hi - lo)
            value = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(value)], names=[*names, *made])

    schema = extended(documents, **{made[0]: "double"})
    return documents.mapInArrow(run, schema)


@query("op2_nbsvm_quality")
def op2_nbsvm_quality(spark, sf_dir):
    """Quality of every document, learned from the labels of four fifths of them."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
