"""Spelling variants: words one edit apart, found through pivotal grams.

A word is a longest run of Latin letters, A-Z in lower case. Runs whose checksum
with the document's id is a multiple of DAMAGE lose one letter (a fixed way to
plant variants); the results of at least LEAST_LENGTH letters that occur
LEAST_COUNT times form the vocabulary.

Bigrams are ranked by how often the vocabulary's words hold them, rare ones first;
there are at most 90 x 90. The *prefix* of a word are its bigrams up to its third
in rank, all places of that bigram included; from it a dynamic program over places
takes the two disjoint ones of least total frequency, the *pivots*. One edit
leaves one of two disjoint bigrams whole. So of two words one edit apart, that
whose prefix ends at the rarer bigram has a pivot in the prefix of the other; and
as no more than one place differs, the words agree from one end up to that pivot:
from the front to the first pivot if the edit lies behind it, else from the second
pivot to the end. Pivots and prefixes are therefore joined on the place from that
end, the letters from there on, and the length of the indexed word, which may
differ by one. Candidates are verified in the join.

Where many words share a key, the letters between are halved: one half must agree
as well, so both sides go on with two longer keys each, again and again while keys
are shared by many. Which keys go on is told by a bitmap of fixed size, and either way is
exact, so a key held there in error costs time only. Words longer than LONG start from
halves of the whole word in place of pivots.

Defined results: a null text has no words; repeated rows count again; a null id
is written as no character; ties among forms go to the smallest word by code
points; an empty table or vocabulary gives an empty table; other columns are not
read, whatever their names. Texts and runs may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.llm.sieve import BITS, PAGE
from series_rank.session import materialize

DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
LONG = 64
WORDS_HELD = 300_000  # distinct runs of a task before their counts are sent on
RUNS_HELD = 1_000_000  # runs of some documents that are numbered together
MANY_PAIRS = 1_000  # pairs that one key may compare
# Shorter runs are not words, and a damaged run is shorter still.
_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST_LENGTH)


def runs(text: str | None) -> list[str]:
    """The runs of a text that are long enough, in order, A-Z in lower case."""
    text = text or ""
    return _RUN.findall(text.lower() if text.isascii() else text.encode().lower().decode())


class _Codes(dict):
    """Numbers of runs in order of appearance, with their checksums and octets."""

    def __init__(self) -> None:
        super().__init__()
        self.runs: list[str] = []
        self.crc: list[int] = []
        self.octets: list[int] = []

    def __missing__(self, run: str) -> int:
        raw = run.encode()
        self[run] = code = len(self.runs)
        self.runs.append(run)
        self.crc.append(zlib.crc32(raw))
        self.octets.append(len(raw))
        return code


# What one octet of zero makes of a checksum's low byte.
_STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.int64)
_TABLE = 128  # octets


def checksums(ids: list, doc: np.ndarray, crc: np.ndarray, octets: np.ndarray) -> np.ndarray:
    """The crc32 of ``<id>:<run>`` for runs of these checksums and octets, each in the document of number *doc*.

    The checksum is linear: that of the id, moved on by the octets of the run, is added to that of the run.
    """
    moved = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.int64)
    steps = np.empty((_TABLE, len(ids)), np.int64)
    first = moved
    for n in range(_TABLE):
        steps[n] = moved
        moved = _STEP[moved & 255] ^ (moved >> 8)
    out = crc ^ steps[np.minimum(octets, _TABLE - 1), doc]
    for k in np.flatnonzero(octets >= _TABLE).tolist():
        zeros = bytes(int(octets[k]))
        out[k] = crc[k] ^ zlib.crc32(zeros, int(first[doc[k]])) ^ zlib.crc32(zeros)
    return out


class _Counts:
    """Counts of words over the documents of a task."""

    def __init__(self) -> None:
        self.codes, self.others, self.counts = _Codes(), {}, np.zeros(0, np.int64)

    def add(self, ids: list, found: list[list[str]]) -> None:
        sizes = [len(f) for f in found]
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
        doc = np.repeat(np.arange(len(ids)), sizes)
        h = checksums(ids, doc, np.array(self.codes.crc, np.int64)[code], np.array(self.codes.octets, np.int64)[code])
        hit = h % DAMAGE == 0
        counts = np.bincount(code[~hit], minlength=len(self.codes))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        for c, at in zip(code[hit].tolist(), h[hit].tolist()):
            run = self.codes.runs[c]
            at %= len(run)
            word = run[:at] + run[at + 1 :]
            if len(word) >= LEAST_LENGTH:
                self.others[word] = self.others.get(word, 0) + 1

    def batch(self) -> pa.RecordBatch:
        held = np.flatnonzero(self.counts)
        words = [self.codes.runs[c] for c in held.tolist()] + list(self.others)
        n = np.concatenate([self.counts[held], np.fromiter(self.others.values(), np.int64, len(self.others))])
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(n, pa.int64())})


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): how often each word of the least length occurs, damaged runs as what is left of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids, found, held = _Counts(), [], [], 0
        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                own = runs(value.as_py())
                if own:
                    ids.append(key.as_py())
                    found.append(own)
                    held += len(own)
                if held > RUNS_HELD:
                    counts.add(ids, found)
                    ids, found, held = [], [], 0
                    if len(counts.codes) + len(counts.others) > WORDS_HELD:
                        yield counts.batch()
                        counts = _Counts()
        if found:
            counts.add(ids, found)
        yield counts.batch()

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(vocabulary: DataFrame) -> dict[str, int]:
    """In how many places of the vocabulary each bigram stands: at most 90 x 90 numbers."""
    grams = vocabulary.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))")).alias("g"))
    return {r.g: r.n for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}


def pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Two disjoint places of bigrams with the least total cost, of ascending *places* with some two apart.

    best[j] is the cheapest place that ends before the j-th begins; the answer
    minimises the cost of the j-th with it.
    """
    chosen, least = None, None
    best, behind = None, 0  # cheapest among the places passed so far
    for place, cost in zip(places, costs):
        while places[behind] + 2 <= place:
            if best is None or costs[behind] < costs[best]:
                best = behind
            behind += 1
        if best is not None and (least is None or costs[best] + cost < least):
            least, chosen = costs[best] + cost, (places[best], place)
    return chosen


class Grams:
    """Prefixes and pivots of words, by the frequency of bigrams."""

    def __init__(self, counts: dict[str, int]) -> None:
        order = sorted(counts, key=lambda g: (counts[g], g))
        self.rank = {g: i for i, g in enumerate(order)}
        self.cost = [counts[g] for g in order]

    def prefix(self, word: str) -> tuple[list[int], list[int], int]:
        """(places of the prefix in ascending order, their bigrams' ranks, the rank of its last bigram)."""
        rank = self.rank
        ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
        end = sorted(ranks)[2]
        places = [i for i, r in enumerate(ranks) if r <= end]
        return places, [ranks[i] for i in places], end

    def pivots(self, places: list[int], ranks: list[int]) -> tuple[int, int]:
        return pivots(places, [self.cost[r] for r in ranks])


def asking(grams: Grams, word: str) -> list[tuple[int, int, int, int]]:
    """(left, right, indexed length, end): the letters from both ends on which a word asks for words of that length."""
    n, out = len(word), []
    if n - 1 <= LONG:
        places, ranks, end = grams.prefix(word)
        first, second = grams.pivots(places, ranks)
        out = [s for m in (n - 1, n, n + 1) if m <= LONG for s in ((first + 2, 0, m, end), (0, n - second, m, end))]
    return out + [s for m in (n - 1, n, n + 1) if m > LONG for s in halves(0, 0, m, -1)]


def asked(grams: Grams, word: str) -> list[tuple[int, int, int, int]]:
    """The same of an indexed word."""
    n = len(word)
    if n > LONG:
        return halves(0, 0, n, 0)
    places, _, end = grams.prefix(word)
    return [s for p in places for s in ((p + 2, 0, n, end), (0, n - p, n, end))]


def halves(left: int, right: int, length: int, end: int) -> list[tuple[int, int, int, int]]:
    """What is left between the ends of the indexed word, halved: one edit leaves one half of it whole."""
    rest = length - left - right
    return [(left + rest // 2, right, length, end), (left, right + rest - rest // 2, length, end)]


def _with_keys(states: Iterator[tuple[str, list[tuple]]]) -> list[tuple]:
    """Rows of STATES: a key stands for the letters at both ends and all numbers but the last."""
    from xxhash import xxh64_intdigest

    out = []
    for word, own in states:
        n = len(word)
        for left, right, length, end in own:
            ends = f"{left},{right},{length},{word[:left]},{word[n - right :]}"
            out.append((xxh64_intdigest(ends) - 0x8000000000000000, word, left, right, length, end))
    return out


STATES = "key long, word string, left int, right int, length int, end int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "word", "left", "right", "length", "end"]
    )


def _first_keys(vocabulary: DataFrame, counts: dict[str, int], states) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(counts)
        for batch in batches:
            yield _batch(_with_keys((w, states(grams, w)) for w in batch.column("word").to_pylist()))

    return vocabulary.select("word").mapInArrow(make, STATES)


def _longer_keys(rows: DataFrame) -> DataFrame:
    """Every row of a key that many share, with two longer keys. Nothing longer is left when one letter is between."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = zip(*(batch.column(c).to_pylist() for c in ("word", "left", "right", "length", "end")))
            yield _batch(_with_keys((w, halves(*state)) for w, *state in states))

    return rows.mapInArrow(make, STATES)


def _shared(asking: DataFrame, asked: DataFrame) -> bytes | None:
    """The keys that would compare too many pairs, in a bitmap of fixed size; None where there are none."""
    growing = F.col("length") - F.col("left") - F.col("right") > 1
    sides = asking.where(growing).select("key", F.lit(0).alias("among")).unionByName(
        asked.where(growing).select("key", F.lit(1).alias("among"))
    )
    sizes = sides.groupBy("key").agg(F.sum("among").alias("a"), F.count(F.lit(1)).alias("n"))
    many = sizes.where(F.col("a") * (F.col("n") - F.col("a")) > MANY_PAIRS)
    place = F.pmod("key", F.lit(BITS))
    pages = many.select(F.floor(place / PAGE).alias("page"), (place % PAGE).alias("bit")).groupBy("page").agg(
        F.bitmap_construct_agg("bit").alias("bits")
    )
    rows = pages.collect()  # at most BITS / PAGE pages
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = bytes(r["bits"])
    return bytes(out) if rows else None


def _flagged(rows: DataFrame, bits: bytes) -> DataFrame:
    """``many``: whether a key is in the bitmap and can grow."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            key, left, right, length = (batch.column(c).to_numpy() for c in ("key", "left", "right", "length"))
            place = key % BITS
            many = (table[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1) & (length - left - right > 1)
            yield batch.append_column("many", pa.array(many))

    return rows.mapInArrow(flag, STATES + ", many boolean")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b): words exactly one inserted, deleted or replaced letter apart, each pair once, a before b.

    *vocabulary* has ``word``, distinct words of at least LEAST_LENGTH letters.
    """
    counts = gram_counts(vocabulary)
    x, y = _first_keys(vocabulary, counts, asking), _first_keys(vocabulary, counts, asked)
    found = []
    while True:
        bits = _shared(x, y)
        if bits is not None:
            x, y = _flagged(x, bits), _flagged(y, bits)
        few = [r.where(~F.col("many")) if bits is not None else r for r in (x, y)]
        left = few[0].select("key", F.col("word").alias("p"), F.col("end").alias("pe"))
        right = few[1].select("key", F.col("word").alias("q"), F.col("end").alias("qe"))
        met = left.join(right, "key").where((F.col("pe") <= F.col("qe")) & (F.levenshtein("p", "q", 1) == 1))
        found.append(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
        if bits is None:
            break
        x, y = (materialize(_longer_keys(r.where("many").drop("many")), "longer-keys") for r in (x, y))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): every word's last form. Forms grow in count by RATIO, so chains are short and never close.

    Each round doubles the steps already taken, until nothing moves.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return steps
        steps = materialize(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocabulary = materialize(counted(docs, doc_id, text).where(F.col("n") >= LEAST_COUNT), "vocabulary")
    pairs = materialize(near_pairs(vocabulary), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocabulary.select(F.col("word").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other"))
    near = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best")
    )
    has_form = -F.col("best.less") >= RATIO * F.col("n")
    named = materialize(
        vocabulary.join(near, "word", "left").select(
            "word",
            F.when(has_form, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(named.where(F.col("form").isNotNull()))
    out = named.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
