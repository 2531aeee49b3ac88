"""Many scripts, repeated ids, clashing names, and the pipeline stage by stage."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import classes, partition

import corpus_pipeline
from catalogops.llm import language, minhash, quality
from catalogops.llm.registry import free
from catalogops.plans.durable import durable

SF_DIR = "/root/testdata/sf0.001"


def texts_in(first, letters, seed, n):
    """Texts of made-up words over ``letters`` code points from ``first`` on."""
    rng = random.Random(seed)
    words = ["".join(chr(first + rng.randrange(letters)) for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)]


SCRIPTS = {"el": (0x3B1, 24), "hy": (0x561, 38), "ka": (0x10D0, 33), "ru": (0x430, 32), "zh": (0x4E00, 3000), "ko": (0xAC00, 900)}


def test_scripts_are_told_apart():
    made = {name: texts_in(*letters, seed, 40) for seed, (name, letters) in enumerate(SCRIPTS.items())}
    parser = language.Parser({name: " ".join(texts[:30]) for name, texts in made.items()})
    for name, texts in made.items():
        phrases, letters = parser.parse(texts[30:])
        own = parser.names.index(name)
        others = np.delete(phrases, own, axis=1).min(axis=1)
        # Another script's letters are each a phrase, so no other language comes near.
        assert (others >= letters).all() and (phrases[:, own] < 0.9 * letters).all()


def test_long_and_short_alphabets_parse_alike(monkeypatch):
    rng = random.Random(2)
    samples = {k: "".join(rng.choice("abcdefg ") for _ in range(900)) for k in "xyz"}
    texts = ["".join(rng.choice("abcdefghq .") for _ in range(rng.randrange(3000))) for _ in range(30)]
    table = language.Parser(samples).parse(texts)
    monkeypatch.setattr(language, "DENSE_LETTERS", 0)
    listed = language.Parser(samples).parse(texts)
    assert (table[0] == listed[0]).all() and (table[1] == listed[1]).all()


def test_fit_is_bounded_by_rows(spark):
    rows = [(1, f"Good text number {i} with some words .") for i in range(3000)] + [(i, f"Text {i} !!! $$$ junk") for i in range(2, 60)]
    labels = [(i, i % 2) for i in range(1, 60)]
    documents, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    weights, bias = quality.fit(documents, labelled, sample=40)
    assert np.isfinite(weights).all() and np.isfinite(bias)
    known = labelled.select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("place"), F.lit(True).alias("sampled"))
    learned = documents.join(known, "doc_id").select("text", "label", "place", "sampled").coalesce(1).mapInArrow(
        quality._learn, "feature long, n0 long, n1 long, label int, place long, indicators binary"
    ).collect()
    assert max(Counter(r["place"] for r in learned if r["place"] is not None).values()) == 1
    assert sum(r["n0"] + r["n1"] for r in learned if r["feature"] is not None) > 3000


def test_fit_sends_no_plain_text(spark, monkeypatch):
    rows = [(i, f"Good text number {i} , with some words ." if i % 2 else f"junk {i} !!! $$$") for i in range(1, 90)]
    rows += [(91, None), (92, ""), (93, "x" * 700_000 + " Ünï"), (1, "another of id 1"), (2, None), (None, "no id")]
    labels = [(i, i % 2) for i in range(1, 94)]
    documents, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found, sent = {}, []

    def seen(df, label):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = df._jdf.queryExecution().explainString(mode)
        sent.extend(line for part in plan.split("\n\n") if ") Exchange\n" in part for line in part.splitlines() if line.startswith("Input"))
        found[label] = durable(df, label)
        return found[label]

    monkeypatch.setattr(quality, "durable", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights, bias = quality.fit(documents, labelled, sample=40)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("packed#" in line for line in sent) and not any("text#" in line for line in sent)
    learned = {r["doc_id"] for r in documents.where(quality.remainder() != 0).collect()}
    want, fitted = Counter(), set()
    for doc_id, text in rows:
        if doc_id in learned:
            _, feature = quality.indicators(*minhash.text_bytes(pa.array([text], pa.string())))
            want.update((int(f), doc_id % 2) for f in feature)
            fitted.add((doc_id % 2, feature.astype(np.int32).tobytes()))
    got = Counter()
    for r in found["learned"].where("feature IS NOT NULL").collect():
        got.update({(r["feature"], 0): r["n0"], (r["feature"], 1): r["n1"]})
    assert +got == want and weights.any() and np.isfinite(bias)
    assert {(r["label"], bytes(r["indicators"])) for r in found["learned"].where("feature IS NULL").collect()} <= fitted


def test_clashing_names_are_kept(spark):
    row = (1, "The cat sat on the mat , and the dog ran .", "en", "a", 7, "b", 0.5, 1.0, "_x", [1], "d", 3, 4)
    frame = spark.createDataFrame(
        [row], "doc_id long, text string, lang string, lang_pred string, quality_score int, lang_score string, phrase_rate double, number double, _id string, ids array<int>, decoded string, _key int, row int"
    )
    told = language.identify(frame, (("en", "the cat sat on the mat and ran"), ("fr", "le chat est sur le tapis")))
    assert told.columns[:13] == frame.columns and told.columns[13:] == ["lang_pred_", "lang_score_", "phrase_rate_"]
    assert tuple(told.first())[:14] == (*row, "en")
    scored = quality.score(frame, (np.zeros(1 << quality.BITS), 0.0))
    assert scored.columns[-1] == "quality_score_" and scored.first()["quality_score"] == 7
    assert [tuple(r) for r in minhash.deduplicated(frame.union(frame)).collect()] == [row]
    assert free(["A", "a"], ["a"]) == ["A_", "a__"]
    bpe = pytest.importorskip("catalogops.llm.bpe")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode(bpe.encode(frame, path), path, ids="ids_").first()
    assert back["ids"] == [1] and back["decoded"] == "d" and bytes(back["decoded_"]).decode() == row[1]


def test_null_ids_are_not_the_least_id(spark):
    frame = spark.createDataFrame([(None, "one two three four five six"), (-(2**63), "one two three four five six seven eight nine"), (None, "other words are here in this text")], "doc_id long, text string")
    kept = minhash.deduplicated(frame).collect()
    assert Counter(map(tuple, kept)) == Counter(map(tuple, frame.collect()))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF_DIR)
        assert name == "packing" or found.columns == docs.columns
        after[name] = corpus_pipeline.durable(found, name)
        docs = after[name]
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    first = after["language"].collect()
    assert ids(first) == sorted(r["doc_id"] for r in given if any(c.isalpha() for c in r["text"] or ""))
    model = quality.fit(after["language"], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    second = after["quality"].collect()
    weights, bias = model[0].astype(np.float32), model[1]
    want = []
    for r in first:
        data, offsets = minhash.text_bytes(pa.array([r["text"]]))
        _, feature = quality.indicators(data, offsets)
        if 1 / (1 + np.exp(-(bias + weights[feature].sum(dtype=float)))) >= quality.THRESHOLD:
            want.append(r["doc_id"])
    assert ids(second) == sorted(want)
    third = after["near_duplicates"].collect()
    groups = partition(ids(second), classes([r["text"] for r in sorted(second, key=lambda r: r["doc_id"])]))
    assert ids(third) == sorted(min(group) for group in groups)
    pieces = after["packing"].collect()
    assert {r["doc_id"] for r in pieces} == set(ids(third))
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    # No more sequences than best fit over the pieces, longest first.
    free_space: list[int] = []
    for length in sorted((r["length"] for r in pieces), reverse=True):
        fits = [i for i, space in enumerate(free_space) if space >= length]
        best = min(fits, key=lambda i: free_space[i]) if fits else None
        if best is None:
            free_space.append(1024 - length)
        else:
            free_space[best] -= length
    assert len(sequences) <= len(free_space)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r["doc_id"], r["length"]) for r in whole) == Counter((r["doc_id"], r["length"]) for r in pieces)


def test_pipeline_of_no_rows(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
