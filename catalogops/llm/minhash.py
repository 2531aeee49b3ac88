"""Near-duplicate classes by ProbMinHash sketches, banding and exact verification.

Each document is the set of its word shingles, all of one weight, however often a text repeats one.
ProbMinHash gives every shingle a Poisson process that reaches the registers one after another; a
register keeps the first to arrive, and a shingle stops as soon as its time is past the text's last
register. With equal weights two texts agree on a register with their plain Jaccard similarity,
which is what is verified.

Registers are banded into buckets. In a bucket all meet its most central member (the hub) first, the
one whose buckets are the largest together: of many copies with edits, that is one with few of them,
which is alike to more than any other, and it is the hub of most buckets. A pair
goes on if its sketches agree on ``SIFT`` of the registers or more and is then verified on the
whole shingle sets; linked documents join one class, and only pairs between classes matter from
then on. A bucket of one class is done. Where all but ``SMALL_BUCKET`` members are of one class,
those few meet all members of other classes, which is a bounded number of pairs for each member. In
the others one hub from outside the largest class meets the rest, and what is still mixed after that
is finished by an exact prefix join of its members' whole shingle sets: with all shingles in one
order, the rarest first, two sets that are similar enough share a shingle among the first few of
both, and how early it comes bounds what they can share at all. Every such pair of two classes is
looked at, so no member is left out for the size of its bucket. The pairs that meet grow with the
square of a group only where its members share a shingle that is rare enough for the start of their
sets, and are still of different classes.

Nulls, ties, repeats: rows of equal shingle sets are one node before any pairing, whatever their
number, and so are equal texts without a word, the empty text included. A null text is alike to
nothing and is its own class. A row is known by its own number, so null and repeated ids are fine.
Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.components import connected_components
from catalogops.llm.registry import free, query, table
from catalogops.llm.textbytes import grams, mix, packed, slices, text_bytes, unpacked, words
from catalogops.plans.durable import Bucketed, durable
from catalogops.plans.skew import skew_join
from catalogops.session import small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
# Sketches that agree on less than this share are no candidates: at similarity 0.8 that is ten
# standard deviations off.
SIFT = 0.4
SMALL_BUCKET = 10
# Shingles are counted in so many cells to tell the rare from the common. Any order is right; this
# table is of a fixed size and travels with the tasks.
CELLS = 1 << 18


def _distinct(data: np.ndarray, offsets: np.ndarray, size: int):
    """Distinct shingles of each text in order of (text, hash): text number, hash."""
    run = words(data, offsets)
    hashes, doc = grams(run.hash, run.doc, size)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.empty(len(hashes), bool)
    new[:1] = True
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], hashes[new]


def _exponential(seed: np.ndarray, step: int) -> np.ndarray:
    bits = mix(seed + np.uint64((step * 0xD1B54A32D192ED03) % 2**64)) >> np.uint64(11)
    return -np.log((bits.astype(np.float64) + 0.5) * 2.0**-53)


def prob_minhash(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) array of the shingle that reached each register first; 0 without shingles.

    A shingle visits every register once, in an order of its own (an odd stride from a random
    start, so ``registers`` is a power of two). With i visited, the next comes after an
    exponential time of rate ``weight * (registers - i) / registers``.
    """
    time = np.full(texts * registers, np.inf)
    first = np.zeros(texts * registers, np.uint64)
    seed = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    start, stride = (seed >> np.uint64(7)).astype(np.int64), (seed >> np.uint64(31)).astype(np.int64) | 1
    now = np.zeros(len(hashes))
    for visited in range(registers):
        now = now + _exponential(seed, visited) * registers / ((registers - visited) * weight)
        at = doc * registers + ((start + visited * stride) & (registers - 1))
        np.minimum.at(time, at, now)
        won = time[at] == now
        first[at[won]] = hashes[won]
        late = time.reshape(texts, registers).max(axis=1)
        alive = now < late[doc]
        if not alive.any():
            break
        doc, hashes, weight, seed, start, stride, now = (x[alive] for x in (doc, hashes, weight, seed, start, stride, now))
    return first.reshape(texts, registers)


def _sketch_batches(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                n, at = hi - lo, offsets[lo : hi + 1] - offsets[lo]
                doc, hashes = _distinct(data[offsets[lo] : offsets[hi]], at, size)
                shingles = np.bincount(doc, minlength=n)
                first = prob_minhash(doc, hashes, np.ones(len(hashes)), n)
                # The set's own key: two sums over its shingles, and how many there are.
                keys = np.zeros((n, 2), np.uint64)
                np.add.at(keys[:, 0], doc, mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
                np.add.at(keys[:, 1], doc, mix(hashes + np.uint64(0x632BE59BD9B4E019)))
                bands = first.reshape(n, BANDS, ROWS)
                folded = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for row in range(ROWS):
                    folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, row])
                low = (mix(first) & np.uint64(0xFFFF)).astype(np.uint16)
                text_key = batch.column("text_key").slice(lo, n)
                set_key = [
                    (f"{shingles[i]}:".encode() + keys[i].tobytes()) if shingles[i] else k and f"text:{k}".encode()
                    for i, k in enumerate(text_key.to_pylist())
                ]
                has = shingles > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), text_key, pa.array(set_key, pa.binary()),
                        pa.ListArray.from_arrays(np.r_[0, np.cumsum(has * BANDS)].astype(np.int32), folded[has].ravel().view(np.int64)),
                        pa.array([low[i].tobytes() if has[i] else b"" for i in range(n)], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _set_batches(size: int):
    """The shingle set of each packed text."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches, ["node"]):
            data, offsets = text_bytes(batch.column("text"))
            doc, hashes = _distinct(data, offsets, size)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = [hashes[ends[i] : ends[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], schema=schema)

    return run


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(CELLS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the task's sets have a shingle of each cell."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        joined = b"".join(batch.column("shingles").to_pylist())
        total += np.bincount(_cells(np.frombuffer(joined, np.uint64)), minlength=CELLS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])


def _prefixes(counts: np.ndarray, similarity: float):
    """The shingles of each set, rarest first, among which any similar set has one too.

    A set of n shingles shares at least ``similarity * n`` with a similar one, so their first common
    shingle in an order of all shingles has no fewer than these from its place on.
    """
    names = ["node", "bucket", "place", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
                first = [x[np.lexsort((x, counts[_cells(x)]))][: _reach(len(x), similarity)] for x in sets]
                reach = [len(x) for x in first]
                buckets = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
                places = np.concatenate([np.arange(n) for n in reach]) if reach else np.zeros(0, np.int64)
                columns = [np.repeat(part.column("node").to_numpy(), reach), buckets, places, np.repeat([len(x) for x in sets], reach)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return run


def _reach(size: int, similarity: float) -> int:
    """How many shingles of a set may come up to the first that a similar set shares; never too few by rounding."""
    return min(size, int(size - np.ceil(similarity * size - 1e-6)) + 1)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree on enough registers."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b")
        )
        keep = pa.array((left == right).mean(axis=1) >= SIFT)
        yield batch.select(["a", "b"]).filter(keep)


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard similarity of the two whole shingle sets of each row."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    for batch in batches:
        found = []
        for left, right in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[place] == x).sum())
            found.append(common / (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], schema=schema)


def _name(text_key: Column, doc_id: Column) -> Column:
    """A row's text and id as one value, null for a null text only: copies of a text do not share it, and a null id is like any other."""
    return F.concat(text_key, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))


def near_duplicates(
    documents: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, small_bucket: int = SMALL_BUCKET
) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, class_size, keeper.

    ``class_id`` is the least doc_id of the class; ``keeper`` marks exactly one row of each.
    """
    text_key = F.md5(F.col("text").cast("binary"))
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key.alias("text_key"))
    sketches = durable(
        columns.mapInArrow(_sketch_batches(shingle), "doc_id long, text_key string, set_key binary, bands array<long>, sketch binary")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("set_key", F.coalesce("set_key", F.encode(F.concat(F.lit("row:"), F.col("row").cast("string")), "utf-8"))),
        "sketches",
    )
    # One node for each distinct shingle set; a minimum combines before the shuffle.
    nodes = durable(sketches.groupBy("set_key").agg(F.min("row").alias("node")), "nodes")
    shown = durable(
        sketches.where(F.size("bands") > 0).join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
        .select(F.col("row").alias("node"), _name(F.col("text_key"), F.col("doc_id")).alias("name"), "bands", "sketch"),
        "shown",
    )
    texts = columns.where(F.col("text").isNotNull()).select(_name(text_key, F.col("doc_id")).alias("name"), "text")
    laid = Bucketed(documents.sparkSession, "texts", "name")
    roots = _roots(texts, laid, shown, shingle, similarity, small_bucket)
    laid.forget()
    named = nodes.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    members = durable(skew_join(sketches.select("row", "doc_id", "text_key", "set_key"), named, ["set_key"]).drop("set_key"), "members")
    classes = members.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("kept"),
    )
    told = skew_join(members, classes, ["root"])
    return told.select("doc_id", "text_key", "class_id", "class_size", (F.col("row") == F.col("kept")).alias("keeper"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: one of each class, and every null text."""
    (name,) = free(["name"], documents.columns)
    kept = near_duplicates(documents.select("doc_id", "text")).where("keeper AND text_key IS NOT NULL")
    kept = kept.select(_name(F.col("text_key"), F.col("doc_id")).alias(name))
    told = documents.where(F.col("text").isNotNull()).withColumn(name, _name(F.md5(F.col("text").cast("binary")), F.col("doc_id").cast("long")))
    # The keeper may be one of several rows that repeat id and text, null ids included. They lie together
    # already where they met it, so whole rows are sent once.
    told = told.join(kept, name, "left_semi").dropDuplicates([name])
    return told.select(*documents.columns).union(documents.where(F.col("text").isNull()))


def _roots(texts: DataFrame, laid: Bucketed, shown: DataFrame, shingle: int, similarity: float, small_bucket: int) -> DataFrame:
    """(node, root) of every node alike to another; root is the least node of the class.

    ``texts`` are sent once, packed, to be laid out by name in ``laid``; every round reads those it asks for from there.
    """
    spark = shown.sparkSession
    rows = shown.select("node", F.explode("bands").alias("bucket"))
    sketch = shown.select("node", "sketch")
    known: list[DataFrame] = []
    compared: list[DataFrame] = []

    def among(frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.union, frames, spark.createDataFrame([], schema))

    def sifted(pairs: DataFrame) -> DataFrame:
        return durable(
            pairs.distinct()
            .join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
            .join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
            .mapInArrow(_sift, "a long, b long")
            .join(among(compared, "a long, b long"), ["a", "b"], "left_anti"),
            "sifted",
        )

    def whole(asked: DataFrame) -> DataFrame:
        """(node, shingles) of all nodes asked for so far; each text is read for it once."""
        fresh = asked.join(among(known, "node long, shingles binary"), "node", "left_anti")
        wanted = named.join(fresh, "node", "left_semi")
        found = laid.rows().join(wanted, "name").select("node", "size", "packed").mapInArrow(_set_batches(shingle), "node long, shingles binary")
        known.append(durable(found, "sets"))
        return among(known, "node long, shingles binary")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are as similar as asked, by their whole shingle sets."""
        asked = whole(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        compared.append(pairs)
        return durable(
            pairs.join(asked.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a")), "a")
            .join(asked.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b")), "b")
            .mapInArrow(_similarity, "a long, b long, similarity double")
            .where(F.col("similarity") >= similarity).select("a", "b"),
            "links",
        )

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The roots once the links are known as well; only links between classes are looked at."""
        of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
        ).where("a <> b")
        moved = connected_components(between)
        old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        return durable(old.union(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")

    def mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of buckets that hold several classes, with the bucket's largest class (main).

        ``hub`` is the most central member outside it, and ``others`` says how many those are.
        """
        named = members.join(roots, "node", "left").select(*members.columns, F.coalesce("root", "node").alias("root"))
        classes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = classes.groupBy("bucket").agg(
            F.sum("n").alias("all"), F.max(F.struct("n", F.col("root").alias("main"))).alias("top"), F.count(F.lit(1)).alias("classes")
        ).where("classes > 1").select("bucket", F.col("top.main").alias("main"), (F.col("all") - F.col("top.n")).alias("others"))
        live = named.join(largest, "bucket")
        return durable(live.join(_hubs(live.where("root <> main")), "bucket"), "buckets")

    # Bucket sizes are counted by sums, and a node is as central as its buckets are large together.
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = durable(rows.join(shared, "bucket"), "shared")
    members = durable(held.drop("n").join(held.groupBy("node").agg(F.sum("n").alias("central")), "node").select("bucket", "node", "central"), "members")
    if members.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    # Only texts that share a bucket are ever compared.
    named = durable(shown.join(members.select("node").distinct(), "node", "left_semi").select("node", "name"), "named")
    frames = texts.mapInArrow(packed("name"), "name string, size long, packed binary").join(named.select("name"), "name", "left_semi")
    laid.add(frames.groupBy("name").agg(F.first("size").alias("size"), F.first("packed").alias("packed")), 0)
    first = members.join(_hubs(members), "bucket").where("node <> hub")
    links = linked(sifted(first.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))))
    roots = merged(spark.createDataFrame([], "node long, root long"), links)
    members = mixed(members, roots)
    if members.isEmpty():
        return roots
    few, many = members.where(F.col("others") <= small_bucket), members.where(F.col("others") > small_bucket)
    outer = few.where("root <> main").select("bucket", F.col("node").alias("x"), F.col("root").alias("own"))
    pairs = few.join(outer, "bucket").where("root <> own").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    met = many.join(many.where("node = hub").select("bucket", F.col("root").alias("own")), "bucket").where("root <> own")
    pairs = pairs.union(met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")))
    roots = merged(roots, linked(sifted(pairs)))
    left = durable(mixed(many.select("bucket", "node", "central"), roots).select("node", "central").distinct(), "left")
    if left.isEmpty():
        return roots
    asked = whole(left.select("node")).join(left.select("node"), "node", "left_semi")
    counts = np.zeros(CELLS, np.int64)
    for row in asked.mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["cell"]] = row["n"]
    prefixes = asked.mapInArrow(_prefixes(counts, similarity), "node long, bucket long, place long, size long").join(left, "node")
    prefixes = mixed(prefixes, roots)
    outer = prefixes.where("root <> main").select(
        "bucket", F.col("node").alias("x"), F.col("root").alias("own"), F.col("place").alias("x_place"), F.col("size").alias("x_size")
    )
    # If this is the first shingle they share, they share no more than what follows it in either.
    most = F.least(F.col("size") - F.col("place"), F.col("x_size") - F.col("x_place"))
    pairs = prefixes.join(outer, "bucket").where("root <> own").where(most * (1 + similarity) >= (F.col("size") + F.col("x_size")) * similarity - 1e-6)
    return merged(roots, linked(sifted(pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")))))


def _hubs(members: DataFrame) -> DataFrame:
    """(bucket, hub): the most central member of each bucket, the least among equals; a maximum combines before the shuffle."""
    best = F.max(F.struct("central", (-F.col("node")).alias("least")))
    return members.groupBy("bucket").agg(best.alias("best")).select("bucket", (-F.col("best.least")).alias("hub"))


@query("op1_minhash_neardup")
def op1_minhash_neardup(spark, sf_dir):
    """Near-duplicate class of every document."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
