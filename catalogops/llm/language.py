"""Language of a text by cross-parsing: which language's own text explains it in the fewest phrases.

For every language a suffix automaton of a bounded sample of its labelled text is built. A text is
parsed greedily: each phrase is the longest match with anything in the sample, found by walking the
automaton until it has no next state. Similar text parses into few long phrases. Phrases times the
logarithm of the sample's length, over the letters read, estimate the cross entropy; the language
with the least wins.

Texts are lower-cased; whatever is no letter is one space. Each language knows all letters of its own
sample, and any other is one that it lacks, so the size of an automaton depends on one sample and
not on the number of languages or scripts. Long texts are parsed in blocks of ``BLOCK`` characters
side by side (every block is read), so that all texts of a batch advance together by one character a
step.

Nulls, ties, repeats: a null text, or one without a letter, is ``und`` with score 0. Ties go to the
language that sorts first. With nothing to learn from, every text is ``und``. Rows without an id
are judged but never learned from. Other columns are carried or ignored, never read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.registry import extended, free, held_out, query, remainder, table

# Characters of labelled text learned per language, rows they come from, and the most from one row.
SAMPLE_CHARS, SAMPLE_ROWS, ROW_CHARS = 32_000, 200, 800
# A language with more letters has its automaton's steps in a sorted list instead of a table.
DENSE_LETTERS = 126
BLOCK = 1024
# Characters parsed together.
SLICE = 1 << 20
# Marks a step that begins a phrase, in a table and in a list.
_BEGUN, _BEGUN_LISTED = 30, 62


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Next states of each state of the suffix automaton by symbol; state 0 starts."""
    size = 2 * len(symbols) + 1
    link, length = [-1] * size, [0] * size
    rows: list[dict[int, int]] = [{}]
    last = 0
    for symbol in symbols:
        new = len(rows)
        rows.append({})
        length[new] = length[last] + 1
        at = last
        while at != -1 and symbol not in rows[at]:
            rows[at][symbol] = new
            at = link[at]
        if at == -1:
            link[new] = 0
        else:
            to = rows[at][symbol]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                clone = len(rows)
                rows.append(dict(rows[to]))
                length[clone], link[clone] = length[at] + 1, link[to]
                while at != -1 and rows[at].get(symbol) == to:
                    rows[at][symbol] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    return rows


class Automaton:
    """One language's steps: from a state by a symbol to a state, marked if a phrase begins with the symbol.

    Symbols are 0 for what is no letter, 1 for a letter that the sample lacks, then its own letters.
    A step that fails, or leaves the start, begins a phrase with this very character; one that the
    sample lacks is a phrase of its own.
    """

    def __init__(self, sample: str):
        lowered = sample.lower()
        known = sorted({c for c in lowered if c.isalpha()})
        self.classes = _letters().astype(np.uint16)
        self.classes[[ord(c) for c in known]] = np.arange(2, 2 + len(known))
        self.width = 2 + len(known)
        code, doc = _codes([lowered])
        rows = suffix_automaton(self.classes[code].tolist())
        # A table of the sample's states is small enough for 32 bits.
        dense = len(known) <= DENSE_LETTERS and len(rows) * self.width < 1 << _BEGUN
        self.bit, kind = (_BEGUN, np.int32) if dense else (_BEGUN_LISTED, np.int64)
        begun = kind(1 << self.bit)
        again = np.full(self.width, begun, kind)
        again[list(rows[0])] = np.array(list(rows[0].values()), kind) * kind(self.width) | begun
        state = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        symbol = np.array([c for r in rows for c in r], np.int64)
        to = np.array([t for r in rows for t in r.values()], kind) * kind(self.width)
        to[state == 0] |= begun
        self.again, self.keys = again, None
        if dense:
            self.table = np.tile(again, len(rows))
            self.table[state * self.width + symbol] = to
        else:
            order = np.argsort(state * self.width + symbol)
            self.keys, self.to = (state * self.width + symbol)[order], to[order]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States times the width, with ``bit`` set where a phrase begins."""
        at = state + symbol
        if self.keys is None:
            return self.table.take(at)
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[place] == at, self.to[place], self.again[symbol])


def _codes(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, runs of non-letters as one, and the text of each."""
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    letter = _letters()[code]
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1] | (doc[1:] != doc[:-1])
    return code[keep], doc[keep]


class Parser:
    """Automata of all languages, and the parse of many texts at a time."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.price = np.array([math.log(max(len(samples[n]), 2)) for n in self.names])
        self.automata = [Automaton(samples[n]) for n in self.names]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each (text, language), and the letters of each text."""
        code, doc = _codes([t.lower() for t in texts])
        n = np.bincount(doc, minlength=len(texts))
        letters = np.bincount(doc[_letters()[code]], minlength=len(texts))
        phrases = np.zeros((len(texts), len(self.names)), np.int64)
        if not len(code):
            return phrases, letters
        starts = np.r_[0, np.cumsum(n)[:-1]]
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(n[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, first, length = owner[order], (starts[owner] + nth * BLOCK)[order], length[order]
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        for k, automaton in enumerate(self.automata):
            symbol = automaton.classes[code].astype(automaton.again.dtype)
            state, begun = np.zeros(len(owner), symbol.dtype), np.zeros(len(owner), symbol.dtype)
            low = symbol.dtype.type((1 << automaton.bit) - 1)
            for step, m in enumerate(live):
                got = automaton.step(state[:m], symbol[first[:m] + step])
                begun[:m] += got >> automaton.bit
                state[:m] = got & low
            phrases[:, k] = np.bincount(owner, begun, minlength=len(texts))
        return phrases, letters


_built: dict[tuple, Parser] = {}


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in each worker process."""
    if samples not in _built:
        _built.clear()
        _built[samples] = Parser(dict(samples))
    return _built[samples]


def learn(documents: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, sample text) of every language of the rows that may be learned from.

    At most ``SAMPLE_ROWS`` distinct passages a language, taken by their hash, until ``SAMPLE_CHARS``
    are reached. A text gives one passage of at most ``ROW_CHARS`` characters, from a place in the
    whole text that its hash tells, so openings that texts share do not stand for them all. Copies
    are one passage before any are taken, whatever their number.
    """
    spots = F.greatest(F.length("text") - ROW_CHARS, F.lit(0)) + 1
    passages = (
        documents.where((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.substring("text", (F.pmod(F.xxhash64("text"), spots) + 1).cast("int"), F.lit(ROW_CHARS)).alias("part"))
        .where(F.col("part").rlike(r"\p{L}"))
        .select("lang", F.xxhash64("part").alias("place"), "part")
    )
    place = Window.partitionBy("lang").orderBy("place")
    taken = passages.select("lang", "place").distinct().withColumn("n", F.row_number().over(place)).where(F.col("n") <= SAMPLE_ROWS)
    # At most SAMPLE_ROWS rows a language; a minimum combines before the shuffle, so copies are no hot spot.
    rows = passages.join(F.broadcast(taken), ["lang", "place"]).groupBy("lang", "n").agg(F.min("part").alias("part")).orderBy("lang", "n").collect()
    samples: dict[str, str] = {}
    for row in rows:
        have = samples.setdefault(row["lang"], "")
        if len(have) < SAMPLE_CHARS and row["part"] not in have:
            samples[row["lang"]] = (have + " \n" + row["part"])[:SAMPLE_CHARS]
    return tuple(sorted(samples.items()))


def identify(documents: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """The columns of ``documents`` and lang_pred, lang_score, phrase_rate (of the winner, per letter).

    New columns that a given one has the name of get an underscore appended. The samples are of a fixed size for each language and travel with the tasks.
    """
    names = list(documents.columns)
    made = free(["lang_pred", "lang_score", "phrase_rate"], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pred: list[str] = []
            score: list[float] = []
            rate: list[float | None] = []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
                    size += len(texts[hi])
                    hi += 1
                phrases, letters = parser.parse(texts[lo:hi])
                for own, count in zip(phrases, letters, strict=True):
                    if not count or not parser.names:
                        pred.append("und"), score.append(0.0), rate.append(None)
                        continue
                    cost = own * parser.price
                    best = int(cost.argmin())
                    rest = np.delete(cost, best)
                    pred.append(parser.names[best])
                    score.append(float(rest.min() / (rest.min() + cost[best])) if len(rest) else 1.0)
                    rate.append(float(own[best] / count))
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                names=[*names, *made],
            )

    schema = extended(documents, **dict(zip(made, ("string", "double", "double"), strict=True)))
    return documents.mapInArrow(run, schema)


@query("op9_cross_parse_language")
def op9_cross_parse_language(spark, sf_dir):
    """Language of every document, learned from four fifths of them."""
    documents = table(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), learn(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "phrase_rate")
