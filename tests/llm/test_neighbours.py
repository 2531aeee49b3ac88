"""The hash-prefix forest beside brute force: few rows, repeated ids, tiny shards and blocks."""

import numpy as np
import pytest

from catalogops.llm import neighbours


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Partitions as on a cluster: small results are not gathered into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def brute(rows, queries, k=10):
    """{query: [(id, distance)]}: the nearest other ids, each as near as its nearest vector."""
    out = {}
    for q in queries:
        best = {}
        for own_id, own in rows:
            if own_id == q:
                for other, vector in rows:
                    if other != q:
                        d = float(np.sqrt(((np.array(vector) - np.array(own)) ** 2).sum()))
                        best[other] = min(d, best.get(other, d))
        out[q] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def found(spark, rows, step, **sizes):
    indexed = neighbours.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.search(indexed, indexed.where(f"vec_id % {step} = 0"), **sizes).orderBy("query_id", "rank").collect():
        own = got.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return got


@pytest.mark.parametrize("n", [1, 5, 9, 11])
@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 3, "query_rows": 2}])
def test_few_rows_are_all_found(spark, n, sizes):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    want = {q: v for q, v in brute(rows, range(n)).items() if v}
    got = found(spark, rows, 1, **sizes)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "query_rows": 3}])
def test_recall_of_shards_and_blocks(spark, sizes):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 16))
    vectors[:170] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    want, got = brute(rows, range(0, 500, 25)), found(spark, rows, 25, **sizes)
    assert all(len(got[q]) == 10 for q in want)
    # Neighbours as far as the tenth are as good as it.
    hits = sum(score <= want[q][-1][1] + 1e-12 for q, own in got.items() for _, score in own)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 4, "query_rows": 1}])
def test_an_id_with_several_vectors_is_as_near_as_its_nearest(spark, sizes):
    rows = [(0, [0.0, 1.0]), (1, [4.0, 1.0]), (1, [0.1, 1.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0]), (3, [5.0, 5.0])] + [(1, [4.0 + i, 1.0]) for i in range(1, 9)]
    assert [(i, round(s, 9)) for i, s in found(spark, rows, 4, **sizes)[0]] == [(1, 0.1), (2, 2.0), (3, round(41**0.5, 9))]
