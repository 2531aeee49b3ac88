"""Hard negatives, virtual slots and periodic runs beside brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalogops.llm import negatives, periodic, slots
from catalogops.llm.registry import registered

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", 1), (2, "", None, 2), (3, " \t\n ", "en", 3), (None, "a b " * 20, "en", 4), (5, "x y z " * 9, "de", 5), (5, "x y z " * 9, "de", 5),
    (6, "la " * 20000, "fr", 6), (7, "日本 語 テ " * 8 + "end", "ja", 7), (8, "one", "en", 8), (9, "w" * 40000, "en", 9),
]
CLASHING = "doc_id long, text string, runs string, shard long"


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def words_like(rng, kind, n):
    if kind < 2:
        return [f"w{rng.randrange(kind + 2)}" for _ in range(n)]
    if kind == 2:
        period = rng.randrange(1, 60)
        cycle = [f"w{rng.randrange(50)}" for _ in range(period)]
        return [f"a{i}" for i in range(rng.randrange(9))] + [cycle[i % period] for i in range(n)] + ["end"] * rng.randrange(4)
    a, b = ["0"], ["0", "1"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_are_those_of_all_periods():
    rng = random.Random(3)
    texts = [words_like(rng, i % 4, rng.randrange(260)) for i in range(160)]
    together = periodic._numbered([[w.encode() for w in t] for t in texts])
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 1
    want = sorted((s + at, n, q) for at, t in zip(starts, texts, strict=True) for s, n, q in brute_runs(t))
    assert len(want) > 500
    assert periodic.periodic_stretches(together, max(map(len, texts))) == want


@pytest.mark.parametrize("size,low,high", [(4, 1, 14), (8, 15, 30), (32, 63, 126)])
def test_transforms_give_every_occurrence(size, low, high):
    rng = np.random.default_rng(size)
    codes = rng.integers(0, 2 if size < 32 else 1 << 13, 400).astype(np.uint64)
    codes[200:] = codes[200 - low : 400 - low]
    blocks = np.arange(0, len(codes) - size + 1, size)
    got = set(zip(*(x.tolist() for x in periodic.occurrences(codes, blocks, size, low, high)), strict=True))
    padded = np.concatenate([codes, np.zeros(high + size, np.uint64)])
    assert got == {(int(b), d) for b in blocks for d in range(low, high + 1) if (padded[b : b + size] == padded[b + d : b + d + size]).all()}


def test_a_text_of_one_word_is_one_run():
    assert periodic.periodic_stretches(periodic._numbered([[b"a"] * 30000]), 30000) == [(0, 30000, 1)]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_periodic_query_beside_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in registered()[0]["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    some = 0
    for doc_id, text in documents:
        words, row = planted(doc_id, text), got[doc_id]
        runs = brute_runs(words) if len(words) < 1500 or zlib.crc32(str(doc_id).encode()) % 10 == 0 else None
        if runs is None:
            continue
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        some += len(runs)
        assert row["n_runs"] == len(runs) and (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert some > 10


def test_periodic_runs_of_odd_rows(spark):
    odd = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in ODD], CLASHING)
    got = periodic.periodic_runs(odd)
    assert got.columns == ["doc_id", "text", "runs", "shard", "n_words", "runs_", "collapsed"]
    for row in got.collect():
        words = WORD.findall(row["text"] or "")
        assert row["n_words"] == len(words) and row["runs"] in ("en", "de", "fr", "ja", None)
        if len(words) < 1000:
            assert [tuple(r) for r in row["runs_"]] == brute_runs(words)
        else:
            assert [tuple(r) for r in row["runs_"]] == [(0, 20000, 1)] and row["collapsed"] == "la"
    assert periodic.periodic_runs(odd.where("false")).count() == 0
    assert {r["doc_id"]: r["text"] for r in periodic.with_planted_periods(odd).where("doc_id = 2 OR doc_id = 1").collect()} == {1: None, 2: ""}


def brute_negatives(rows, anchors):
    """``rows``: {id: (label, vector)}."""
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=True))
    out = []
    for a in anchors:
        mates = [b for b in rows if b != a and len(rows[b][1]) == len(rows[a][1])]
        ranked = sorted(((-score(a, b), b) for b in mates))
        best = [(b, -s) for s, b in ranked if rows[b][0] == rows[a][0]][:5]
        for positive, own in best:
            fits = [(b, -s) for s, b in ranked if rows[b][0] != rows[a][0] and 50 * own <= -100 * s <= 95 * own][:3]
            out += [(a, positive, rank, b, own, s) for rank, (b, s) in enumerate(fits, 1)]
    return sorted(out)


@pytest.fixture
def many_partitions(spark):
    """Partitions as on a cluster: small results are not gathered into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("kind", ["near", "equal", "spread", "few", "one label"])
def test_hard_negatives_are_those_of_all_pairs(spark, many_partitions, kind):
    rng = np.random.default_rng(len(kind))
    n, size = (7, 5) if kind == "few" else (400, 24)
    middle = rng.normal(size=(6, size)) * 40
    vectors = np.floor(middle[rng.integers(0, 6, n)] + rng.normal(size=(n, size)) * (4 if kind == "near" else 40)).astype(int)
    if kind == "equal":
        vectors[: n // 3] = vectors[0]
    labels = np.zeros(n, int) if kind == "one label" else rng.integers(0, 4, n)
    rows = {i: (int(labels[i]), vectors[i].tolist()) for i in range(n)}
    frame = spark.createDataFrame([(i, a, v) for i, (a, v) in rows.items()], "vec_id long, label long, vector array<long>")
    want = brute_negatives(rows, range(0, n, 10))
    for shard, anchors in ((1 << 13, 1 << 10), (60, 9)):
        got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, shard_rows=shard, anchor_rows=anchors)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert kind in ("few", "one label") or len(want) > 100


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for size in (1, 3, 4, 17, 64):
        vectors = rng.integers(-300, 300, (50, size)) * rng.integers(0, 2, (50, 1))
        both = [negatives.summaries(vectors.astype(float), n) for n in negatives.LEVELS]
        side = negatives.Side(
            pd.DataFrame(
                {
                    "vec_id": np.arange(50), "label": 0, "vector": list(vectors), "means": list(np.hstack([b[0] for b in both])),
                    "deviations": list(np.hstack([b[1] for b in both])),
                }
            )
        )
        score, wide = vectors @ vectors.T, np.inf
        for level in range(len(negatives.LEVELS)):
            low, high = negatives.bounds(side, np.arange(50), side, np.arange(50), level)
            assert (low <= score).all() and (score <= high).all()
            assert (high - low).sum() <= wide * (1 + 1e-9)
            wide = (high - low).sum()


def test_hard_negatives_of_odd_rows(spark):
    vector = [0.5, -0.25, 1.0]
    rows = [
        (0, 1, vector, "a"), (1, 1, vector, "a"), (1, 1, vector, "a"), (2, 2, [0.3, -0.2, 0.9], "a"), (3, 2, [0.5, None, 1.0], "a"), (4, 2, [0.5, float("nan"), 1.0], None),
        (5, None, vector, "a"), (None, 2, vector, "a"), (6, 2, None, "a"), (7, 2, [], "a"), (8, 2, [0.4, 0.0, 0.8, 0.0], "a"), (9, 3, [float("inf"), 0.0, 0.0], "a"), (10, 3, [0.0, 0.0, 0.0], "a"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, shard string")
    whole = negatives.whole_numbers(frame)
    assert sorted(r["vec_id"] for r in whole.collect()) == [0, 1, 1, 2, 7, 8, 10]
    got = [tuple(r) for r in negatives.hard_negatives(whole, F.col("vec_id") >= 0).orderBy("anchor_id").collect()]
    known = {r["vec_id"]: (r["label"], r["vector"]) for r in whole.collect()}
    assert got == brute_negatives(known, sorted(known)) and len(got) == 2
    assert negatives.hard_negatives(whole.where("false"), F.lit(True)).count() == 0


def test_hard_negative_query_beside_sql(spark):
    from oracle import connect, difference

    queries, oracles = registered()
    name = "op11_segment_hard_negatives"
    assert difference(queries[name](spark, SF_DIR), connect(SF_DIR), oracles[name]) is None


def test_virtual_slot_query(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = registered()[0]["op12_virtual_slots"](spark, SF_DIR).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(got) == len(documents)
    places, sizes = [[] for _ in range(24)], [0] * 24
    for doc_id, text in documents:
        row, data = got[doc_id], (text or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert row["next_shard"] in (row["shard"], 24)
        places[row["shard"]].append(row["slot"])
        sizes[row["shard"]] += row["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(sizes) < 1.05 * sum(sizes) / 24


def test_maps_are_even_and_edited_sparingly(spark, tmp_path):
    rng = np.random.default_rng(2)
    weights = (rng.pareto(1.5, 8192) * 1000).astype(np.int64)
    size = lambda m, n: np.bincount(m, weights, minlength=n)
    first = slots.planned(weights, 24)
    assert size(first, 24).max() - size(first, 24).min() <= np.sort(weights)[24:].max()
    more = slots.grown(first, weights, 27)
    assert set(more[more != first]) == {24, 25, 26} and size(more, 27).max() <= 1.02 * max(weights.sum() / 27, weights.max())
    drift = weights * np.where(first < 3, 3, 1)
    held = lambda m: np.bincount(m, drift, minlength=24)
    even = slots.rebalanced(first, drift, 24)
    assert held(even).max() <= 1.011 * drift.sum() / 24 and (even != first).mean() < 0.35
    assert (slots.rebalanced(even, drift, 24) == even).all()
    stored = slots.SlotMap(spark, str(tmp_path / "map"))
    stored.store(1, first)
    stored.store(2, even)
    assert (stored.shards_of(1) == first).all() and (stored.shards_of(2) == even).all()
    with pytest.raises(Exception, match="exists"):
        stored.store(2, first)


def test_slots_of_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in ODD] * 2, CLASHING)
    records = slots.slotted(odd, 64)
    weights = slots.slot_bytes(records, 64)
    stored = slots.SlotMap(spark, str(tmp_path / "map"))
    stored.store(1, slots.planned(weights, 3))
    rows = slots.placed(records, stored.read(1)).collect()
    assert len(rows) == 2 * len(ODD) and sum(r["size"] for r in rows) == weights.sum()
    for shard in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    told = slots.sharded(odd, stored.read(1), 64)
    assert told.columns == [*odd.columns, "shard_"] and told.count() == 2 * len(ODD)
    none = records.where("false")
    assert slots.slot_bytes(none, 64).sum() == 0 and slots.placed(none, stored.read(1)).count() == 0
    assert set(slots.planned(np.zeros(64, np.int64), 3)) == {0, 1, 2}
