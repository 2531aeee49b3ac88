"""Training-text operators beside brute force, on the smallest tables and on odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from catalogops.llm import bpe, chat, components, fingerprints, language, licenses, minhash, neighbours, packing, quality, urls
from catalogops.llm.pretokens import PATTERN
from catalogops.llm.registry import registered

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, row long"
ODD = [
    (1, None, "en", None, 1), (2, "", None, "a", 2), (3, "  \n ", "en", "a", 3), (None, "the cat sat on the mat", "en", "a", 4),
    (5, "the cat sat on the mat", "en", "a", 5), (5, "the cat sat on the mat", "en", "a", 5), (6, "!!! ???", "en", "a", 6),
    (7, "x" * 30000, "en", "a", 7), (8, "der Hund und die Katze " * 2000, "de", "a", 8), (9, "日本語 テキスト 😀 é", None, "a", 9), (10, "one", "en", "b", 10),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_list(text):
    return WORD.findall(lower(text))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def shingles(text, size=5):
    own = word_list(text)
    return {tuple(own[i : i + size]) for i in range(max(len(own) - size + 1, 1))} if own else set()


def classes(rows):
    """Least row number of each row's class by all pairs: equal texts, or similar shingle sets."""
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            alike = rows[i] is not None and rows[i] == rows[j]
            if not alike and sets[i] and sets[j]:
                alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def partition(ids, labels):
    groups = defaultdict(list)
    for i, label in zip(ids, labels, strict=True):
        groups[label].append(i)
    return Counter(tuple(sorted(g, key=str)) for g in groups.values())


def test_near_duplicates_are_those_of_all_pairs(documents):
    rows = documents.orderBy("doc_id").collect()
    want = partition([r["doc_id"] for r in rows], classes([r["text"] for r in rows]))
    got = minhash.near_duplicates(documents).collect()
    assert partition([r["doc_id"] for r in got], [r["class_id"] for r in got]) == want
    assert sum(r["keeper"] for r in got) == len(want)


def test_near_duplicates_of_a_group_of_edits(spark):
    """Many different edits of one text: the hub takes the near ones, the far ones meet each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9])):
            own[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    want = partition([r[0] for r in rows], classes([r[1] for r in rows]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(frame, small_bucket=4).collect()
    assert partition([r["doc_id"] for r in got], [r["class_id"] for r in got]) == want


def test_near_duplicates_in_a_family_of_templates(spark):
    """Texts of one template share every bucket without being alike; pairs just alike, whose sketches agree least."""
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    template, size = words(181), 5
    # Any two of the family share 177 of 223 shingles, a pair 178 of 222.
    text = lambda both: " ".join(template + both + words(22))
    family, pairs = [text(words(1)) for _ in range(400)], []
    for _ in range(4000):
        both = words(1)
        pairs += [text(both), text(both)]
    data, offsets = minhash.text_bytes(pa.array(pairs))
    doc, hashes = minhash._distinct(data, offsets, size)
    sketches = minhash.prob_minhash(doc, hashes, np.ones(len(hashes)), len(pairs)).reshape(-1, 2, minhash.REGISTERS)
    shared = np.isin(sketches[:, 0], hashes[doc == 0]) & np.isin(sketches[:, 0], hashes[doc == 2])
    agree = sketches[:, 0] == sketches[:, 1]
    agree = np.where((agree & ~shared).any(axis=1), minhash.REGISTERS, agree.sum(axis=1))
    for i in np.argsort(agree, kind="stable")[:20]:
        family += pairs[2 * i : 2 * i + 2]
    want = partition(range(len(family)), classes(family))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(family)), "doc_id long, text string"), small_bucket=0).collect()
    assert Counter(map(len, want)) == {1: 400, 2: 20}
    assert partition([r["doc_id"] for r in got], [r["class_id"] for r in got]) == want


def test_near_duplicates_that_repeat_passages(spark):
    """Sets are alike whatever a text repeats: one text repeats its first half, the other its second."""
    rng = random.Random(7)
    rows = []
    for i in range(6):
        one, two = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2))
        rows += [(2 * i, " ".join([one] * 200 + [two])), (2 * i + 1, " ".join([one] + [two] * 200))]
    want = partition([r[0] for r in rows], classes([r[1] for r in rows]))
    assert len(want) == 6
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert partition([r["doc_id"] for r in got], [r["class_id"] for r in got]) == want


def test_near_duplicates_of_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and sum(r["keeper"] for r in got) == len({r[1] for r in ODD})
    kept = minhash.deduplicated(odd).collect()
    assert sorted(str(r["text"]) for r in kept) == sorted({str(r[1]) for r in ODD})
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "row"}
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicated(empty).count() == 0


def test_registers_agree_with_the_probability_jaccard():
    rng = np.random.default_rng(3)
    hashes = rng.integers(1, 2**63, 300, dtype=np.uint64)
    x, y = rng.exponential(size=300), rng.exponential(size=300)
    x[200:], y[:100] = 0, 0
    want = sum(1 / np.maximum(x / x[d], np.divide(y, y[d])).sum() for d in range(100, 200))
    agree = []
    for seed in range(40):
        salted = minhash.mix(hashes + np.uint64(seed))
        at = lambda w: minhash.prob_minhash(np.zeros((w > 0).sum(), np.int64), salted[w > 0], w[w > 0], 1)[0]  # noqa: B023, E731
        agree.append((at(x) == at(y)).mean())
    assert abs(np.mean(agree) - want) < 0.02


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i + 1000, i + 1001) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = registered()[0]["op2_nbsvm_quality"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.98
    assert np.mean([r["predicted"] for r in scored if r["quality"] == 1]) > 0.99
    assert docs.count() > len(scored)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["quality_score"] for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_dual_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(60)]
    scale = rng.normal(size=20)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    weights = quality.dual_coordinate_descent(rows, y, scale, cost=0.5, rounds=400)
    dense = np.zeros((60, 21))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r]
    dense[:, -1] = 1
    loss = lambda w: 0.5 * w @ w + 0.5 * np.maximum(0, 1 - y * (dense @ w)).sum()
    assert all(loss(weights) <= loss(weights + rng.normal(size=21) * s) + 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_language_parse_is_the_greedy_one():
    samples = {"a": "abab cabc abba", "b": "xyzzy abx"}
    parser = language.Parser(samples)
    texts = ["", "abab abba xyz", "zzz", "qq ab", "ab " * 900]
    phrases, _ = parser.parse(texts)
    for k, name in enumerate(parser.names):
        symbols = lambda text, k=k: parser.automata[k].classes[language._codes([text])[0]].astype(np.uint8).tobytes()
        known = symbols(samples[name])
        for i, text in enumerate(texts):
            own, count = symbols(text), 0
            for lo in range(0, len(own), language.BLOCK):
                part, at = own[lo : lo + language.BLOCK], 0
                while at < len(part):
                    n = 1
                    while at + n < len(part) and part[at : at + n + 1] in known:
                        n += 1
                    at, count = at + n, count + 1
            assert phrases[i, k] == count, (name, text[:20])


def test_language_on_held_out_rows(spark, documents, odd, empty):
    found = registered()[0]["op9_cross_parse_language"](spark, "/root/testdata/sf0.1")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99
    samples = language.learn(documents)
    got = {r["row"]: r for r in language.identify(odd, samples).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 6)] == ["und"] * 4 and got[8]["lang_pred"] == "de"
    assert language.identify(empty, samples).count() == 0 and language.learn(empty) == ()
    assert {r["lang_pred"] for r in language.identify(odd, ()).collect()} == {"und"}


def test_language_samples_are_of_distinct_texts(spark):
    """Copies in hundreds with the least hashes, and an opening that all texts share, leave room for the others."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    short = [" ".join(word() for _ in range(25)) for _ in range(250)]
    opening = " ".join(word() for _ in range(200))
    texts = spark.createDataFrame([(t,) for t in short], "text string").selectExpr("text", "xxhash64(text) h").orderBy("h").collect()
    own = [r["text"] for r in texts] + [r["text"] for r in texts[:3] for _ in range(400)]
    rows = [(t, "copies") for t in own] + [(f"{opening} {' '.join(word() for _ in range(400))}", "opening") for _ in range(60)]
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 5)
    frame = spark.createDataFrame([(next(ids), text, lang) for text, lang in rows], "doc_id long, text string, lang string")
    samples = dict(language.learn(frame))
    assert {lang: len(sample) for lang, sample in samples.items()} == {"copies": language.SAMPLE_CHARS, "opening": language.SAMPLE_CHARS}
    assert sum(t in samples["copies"] for t in short) >= language.SAMPLE_CHARS // 180


def test_neighbours_beside_brute_force(spark):
    given = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in given]), np.array([r["embedding"] for r in given], np.float64)
    got = registered()[0]["op3_hash_prefix_forest"](spark, SF_DIR).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, distance)) if ids[i] != q][:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [r["score"] for r in own] == sorted(r["score"] for r in own)
        assert all(r["score"] == distance[ids == r["vec_id"]][0] for r in own)
        hits, total = hits + len({r["vec_id"] for r in own} & set(ids[order])), total + 10
    assert hits / total >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0, 0.0]), (2, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    indexed = neighbours.index(frame)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(indexed, indexed.where("vec_id in (0, 9)")).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert neighbours.search(neighbours.index(frame.limit(0)), neighbours.index(frame.limit(0))).count() == 0


def test_packing_is_gapless_and_whole(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (spark.read.parquet(f"{SF_DIR}/documents.parquet"), odd):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = Counter()
        for doc_id, text in texts:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
            start, cut, piece = 0, (len(ids) - 1) % 1024 + 1, 0
            while start < len(ids):
                want[doc_id, piece, start, cut - start, zlib.crc32(ids[start:cut].tobytes())] += 1
                start, cut, piece = cut, cut + 1024, piece + 1
        got = packing.pack(packing.pieces(docs, path)).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.1 + 1
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_plan_is_best_fit_by_count():
    rng = random.Random(4)
    for capacity in (7, 16, 50):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 80]))]
            bins = []
            for n in sorted(lengths, reverse=True):
                fits = [i for i, free in enumerate(bins) if free >= n]
                if fits:
                    bins[min(fits, key=lambda i: bins[i])] -= n
                else:
                    bins.append(capacity - n)
            assert packing.best_fit_plan(dict(Counter(lengths)), capacity)[1] == len(bins)


def test_packing_ids_are_the_tokenizers_own():
    import public_tokenizers

    own = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.ranked is not None
    draw = np.random.default_rng(5)
    signs = [*"abZé語ß1२³'’.,-_ \t\n\r\x1c\x1f\x85\xa0\u2003\u2028\u3000\u180e\ufeff\u0301\0😀", " ", " ", "  ", "'s", "'LL", "the"]
    texts = ["".join(draw.choice(signs, draw.integers(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 200_000, " " * 200_000, "x" + "\n" * 3000 + "y", "a <|endoftext|> b", "no<|endoftext|>"]
    for text in texts:
        whole = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole


def test_bpe_is_the_rank_files_own(spark, odd):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert PATTERN == public.PATTERN
    rng = random.Random(1)
    texts = ["", " ", "a\x1cb\x1d \x1f\x85 x", "\n \n  hi\t\t", "'s't'reS 'LL", "½²³ Ⅷ", "a" * 3000, "<|endoftext|>", "x 　 y", "a\n \nb", "a   b \n"]
    texts += ["".join(rng.choice("ab \n\t'sé日 \x1c1½!") for _ in range(50)) for _ in range(1500)]
    codec = bpe.codec(path)
    for text in texts:
        assert codec.encode(text).tolist() == own.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in got) and len(got) == len(ODD)
    digest = {r["doc_id"]: r for r in bpe.digests(odd.where("doc_id = 9"), path).collect()}[9]
    ids = own.encode_ordinary(ODD[9][1])
    assert digest["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digest["n_tokens"] == len(ids)


def test_url_filter_follows_redirects(spark):
    page = lambda canonical: f'<html><head><LINK rel="canonical" href="{canonical}"></head></html>'
    refresh = '<meta http-equiv="refresh" content="0; url=http://bad.example.net/xx">'
    rows = [
        (1, "http://a.org/1", page("https://b.org/2")), (2, "https://B.org/2#top", refresh), (3, "http://a.org/fr/3", page("/1")),
        (4, "http://c.org/4", None), (5, None, page("x")), (6, "no host", refresh), (7, "http://x.example.net/en/7", refresh),
        (8, "http://x.net/en", ""), (9, "http://deep.a.org/x/y", page("../z")), (4, "http://c.org/4", None), (10, "s://example.com/de/?q", None),
    ]
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter({
        (1, None, "block"): 1, (2, None, "block"): 1, (3, "org/fr/", "allow"): 1, (4, None, "allow"): 2, (5, None, "allow"): 1, (6, None, "allow"): 1,
        (7, "example.net/en/", "allow"): 1, (8, "net/", "block"): 1, (9, None, "allow"): 1, (10, "example.com/de/", "block"): 1,
    })


def test_url_filter_beside_sql(spark):
    from oracle import connect, difference

    queries, oracles = registered()
    assert difference(queries["op6_redirect_url_filter"](spark, SF_DIR), connect(SF_DIR), oracles["op6_redirect_url_filter"]) is None


def test_chat_is_read_back(spark):
    odd = "</s>[INST] ok [/INST] <|im_end|>\n<\\|im_start|> <\\\\s> <<SYS>>"
    rows = [
        (1, 1, "assistant", odd), (1, 0, "user", odd), (1, 0, "user", odd), (2, None, None, None), (2, 0, "a\nb\\n", "é😀"), (None, 3, "assistant", ""),
        (3, 0, "assistant", "x" * 100000), (3, 1, "assistant", "<|im_end|>" * 50),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(frame)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[conv].append((role or "", text or ""))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chat(frame.limit(0))).count() == 0


def test_license_places_beside_a_plain_scan(spark, documents, odd, empty):
    text = "x MIT License, mit license; the General Public\nLicense! Licensed under the new Apache License, Version 2.0. licensed under cc by nc 4 0"
    extra = spark.createDataFrame([(500, text, None, None, 0), (500, text, None, None, 0), (501, "mit mit license license", None, None, 0)], DOCUMENTS)
    frame = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra.select("doc_id", "text"))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    want = Counter()
    for doc_id, given in frame.collect():
        own = word_list(given)
        places = [(i, label) for label, p in phrases.items() for i in range(len(own)) if own[i : i + len(p)] == p]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        want[doc_id, len(own), len(places), first, last, ",".join(sorted({x for _, x in places}))] += 1
    columns = "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"
    result = licenses.digests(licenses.scan(frame)).collect()
    assert Counter(tuple(r[c] for c in columns) for r in result) == want
    labels = {r["doc_id"]: r["labels"] for r in result}
    assert labels[500] == "apache,apache-notice,cc-by-nc,gpl,mit"
    assert licenses.scan(empty).count() == 0


def winnow(text):
    own = word_list(text)
    size, window = fingerprints.GRAM, fingerprints.WINDOW
    return [tuple(own[i : i + size]) for i in range(max(len(own) - size + 1, 1))] if own else [], window


def test_fingerprints_beside_brute_force(spark, documents, odd, empty):
    for frame in (documents.limit(60), odd.where("doc_id is not null and row <> 5")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), reverse=True)
        got = {r["doc_id"]: r for r in fingerprints.edited(frame).collect()}
        grams = sorted({g for _, t in rows for g in winnow(t)[0]})
        hashes = {}
        if grams:
            made = spark.createDataFrame([(list(g),) for g in grams], "g array<string>").selectExpr("g", "shiftright(xxhash64(g), 32) h").collect()
            hashes = {tuple(r["g"]): r["h"] for r in made}

        def kept(text):
            own, window = winnow(text)
            values = [hashes.get(g, None) for g in own]
            spots = []
            for lo in range(max(len(values) - window + 1, 1) if values else 0):
                part = range(lo, min(lo + window, len(values)))
                best = min(part, key=lambda i: (values[i], -i))
                if best not in spots:
                    spots.append(best)
            return ",".join(f"{values[i] & 0xFFFFFFFF:x}:{i:x}" for i in spots), {values[i] for i in spots}

        for at, (doc_id, text) in enumerate(rows):
            after = rows[(at + 1) % len(rows)][1]
            half = len(text) // 2
            edit = text[: len(text) - half] + after[:half]
            row = got[doc_id]
            assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
            shown, own = kept(text)
            _, other = kept(after)
            assert row["fingerprint"] == shown
            assert row["near_next"] == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)
    assert fingerprints.edited(empty).count() == 0


def test_fingerprints_of_repeated_rows(odd):
    got = fingerprints.edited(odd).collect()
    assert len(got) == len(ODD)
    assert len({(r["fingerprint"], r["n_chars"]) for r in got if r["n_chars"] == 22}) == 1
