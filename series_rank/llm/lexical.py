"""Ranked lexical search: an Aho-Corasick scan of the documents for the terms of all items.

A term is a longest run of ASCII letters, digits and non-ASCII characters, A-Z
in lower case. Every other character of a text becomes the guard, a space; the
automaton holds each term between two guards, so it finds whole terms only.

The documents are read twice and nothing of them is kept in between: the first
scan adds up the number of documents, of terms, and of documents holding each
term of the items; with these the second scan scores every document for every
item that an output of the automaton maps to, and hands on a task's best. The
best of all tasks are then found in two steps of bounded groups.

The automaton is broadcast. Its size is bounded: items are dealt to shards of at
most about SHARD_TERMS terms, counted before any is collected, and each shard
scans the documents on its own. One item is never divided, so a single item's
own terms are the least bound.

Defined results: a null text has no term, such documents do not count and are
never found; items without a term (null texts) find nothing; repeated documents
are ranked each, repeated items (equal item_id) are one item with the terms of
all; documents with a null id come after all others of their score; a null item_id is an
item of its own; an empty table on either side gives an empty table; other
columns are not read. Texts are scanned whole, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
SHARD_TERMS = 1_000_000  # (item, term) pairs of a shard
SHARD_ITEMS = 20_000
BLOCK_CELLS = 2_000_000  # scores held at a time: documents x items
HELD = 50_000  # candidates of a task before the worse ones are dropped
SPREAD = 64  # groups of the first of the two steps to the best of all tasks
NO_ID = np.iinfo(np.int64).max

# Every byte of a term for itself, A-Z in lower case, any other ASCII character as the guard.
_GUARDED = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def guarded(text: str | None) -> bytes:
    """The text in UTF-8 with guards between and around its terms."""
    return b" " + (text or "").encode().translate(_GUARDED) + b" "


def terms(text: str | None) -> list[bytes]:
    return guarded(text).split()


@dataclass(frozen=True)
class Lexicon:
    """The automaton of some items' terms and the items that each of its outputs maps to."""

    automaton: object
    n_terms: int
    items: list  # ids
    postings: np.ndarray  # item numbers, term by term
    starts: np.ndarray  # of each term's item numbers, one more than terms

    @classmethod
    def of(cls, texts: list[tuple[object, str | None]]) -> Lexicon | None:
        import ahocorasick

        number: dict = {}
        wanted: dict[bytes, set[int]] = {}
        for item, text in texts:
            i = number.setdefault(item, len(number))
            for t in terms(text):
                wanted.setdefault(t, set()).add(i)
        if not wanted:
            return None
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, t in enumerate(wanted):
            automaton.add_word(f" {t.decode('latin-1')} ", n)  # one character a byte
        automaton.make_automaton()
        postings = np.concatenate([np.array(sorted(s), np.int64) for s in wanted.values()])
        starts = np.cumsum([0, *(len(s) for s in wanted.values())])
        return cls(automaton, len(wanted), list(number), postings, starts)

    def counts(self, text: str | None) -> tuple[int, Counter]:
        """Number of terms of a text, and how often each term of the lexicon is among them."""
        raw = guarded(text)
        n = len(raw.split())
        return n, Counter(map(itemgetter(1), self.automaton.iter(raw.decode("latin-1")))) if n else Counter()


def shards(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in parts whose terms, counted beforehand, stay within the bounds where more than one item is in a part."""
    sized = items.select(
        F.col(item).alias("item"), F.col(text).alias("text"), F.xxhash64(item).alias("h"),
        (F.octet_length(F.coalesce(text, F.lit(""))) / 2 + 1).alias("terms"),  # no text has more
    )
    whole = sized.agg(F.sum("terms").alias("terms"), F.count(F.lit(1)).alias("n")).first()
    if not whole.n:
        return
    parts = max(-(-int(whole.terms) // SHARD_TERMS), -(-whole.n // SHARD_ITEMS))
    while parts > 1:
        part = F.pmod("h", F.lit(parts)).alias("part")
        sizes = sized.groupBy(part).agg(F.sum("terms").alias("terms"), F.countDistinct("h").alias("items"), F.count(F.lit(1)).alias("n"))
        over = (F.col("terms") > 2 * SHARD_TERMS) | (F.col("n") > 2 * SHARD_ITEMS)
        if sizes.where(over & (F.col("items") > 1)).isEmpty() or parts >= 2 * whole.n:
            break
        parts *= 2
    for p in range(parts):
        yield [(r.item, r.text) for r in sized.where(F.pmod("h", F.lit(parts)) == p).collect()]


def _statistics(docs: DataFrame, held) -> DataFrame:
    """(term, n): documents holding each term; -1 numbers the documents, -2 their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = held.value
        df, total_docs, total_terms = np.zeros(lexicon.n_terms, np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                n, found = lexicon.counts(text.as_py())
                if n:
                    total_docs, total_terms = total_docs + 1, total_terms + n
                    if found:
                        df[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict(
            {"term": np.concatenate([at, [-1, -2]]), "n": np.concatenate([df[at], [total_docs, total_terms]])}
        )

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Best:
    """The best documents of each item so far, ties to smaller ids."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.item = self.score = self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)
        self.least = np.ones(items, np.int64)  # a score must reach this
        self.last = np.full(items, NO_ID)  # and have an id up to this one where it does just that

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """*scores* has a row a document and a column an item."""
        good = (scores > self.least) | ((scores == self.least) & (docs[:, None] <= self.last))
        row, item = np.nonzero(good)
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[row, item]])
        self.doc = np.concatenate([self.doc, docs[row]])
        self.null = np.concatenate([self.null, null[row]])
        if len(self.item) > HELD + self.top * len(self.least):
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.null, self.doc, -self.score, self.item))
        item = self.item[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        kept = order[place < self.top]
        last = order[place == self.top - 1]
        self.least[self.item[last]] = self.score[last]
        self.last[self.item[last]] = self.doc[last]
        self.item, self.score, self.doc, self.null = (v[kept] for v in (self.item, self.score, self.doc, self.null))


class _Scorer:
    """Scores of some documents for all items of a lexicon, from their terms' counts."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.lexicon, self.weights, self.n_docs, self.n_terms = lexicon, weights, n_docs, n_terms
        n_items = len(lexicon.items)
        self.degree = np.diff(lexicon.starts)
        # Terms of many items are a small dense table; the others are looked up in the lists of items.
        often = np.flatnonzero(self.degree > max(8, n_items // 16))
        self.dense = np.zeros((len(often), n_items))
        self.place = np.full(lexicon.n_terms, -1)
        self.place[often] = np.arange(len(often))
        for row, t in enumerate(often):
            self.dense[row, lexicon.postings[lexicon.starts[t] : lexicon.starts[t + 1]]] = 1.0
        most = np.bincount(lexicon.postings).max() * int(weights.max(initial=0)) * 1_000_000
        if most >= 1 << 53:
            raise OverflowError("an item has more terms than its scores can hold exactly")

    def scores(self, lengths: list[int], found: list[Counter]) -> np.ndarray:
        n_items, d = len(self.lexicon.items), len(found)
        sizes = [len(f) for f in found]
        doc = np.repeat(np.arange(d), sizes)
        term = np.fromiter((t for f in found for t in f), np.int64, sum(sizes))
        tf = np.fromiter((c for f in found for c in f.values()), np.int64, sum(sizes))
        m = np.array([100 - 90 + 90 * n * self.n_docs // self.n_terms for n in lengths], np.int64)
        part = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        place = self.place[term]
        often = place >= 0
        table = np.zeros((d, len(self.dense)))
        table[doc[often], place[often]] = part[often]
        out = (table @ self.dense).astype(np.int64)
        doc, term, part = doc[~often], term[~often], part[~often]
        reps = self.degree[term]
        if reps.sum():
            ends = np.cumsum(reps)
            at = np.arange(ends[-1]) + np.repeat(self.lexicon.starts[term] - (ends - reps), reps)
            cell = np.repeat(doc, reps) * n_items + self.lexicon.postings[at]
            # Sums of whole numbers below 2**53, so doubles hold them exactly.
            out += np.bincount(cell, np.repeat(part, reps), d * n_items).astype(np.int64).reshape(d, n_items)
        return out


def _scored(docs: DataFrame, held, statistics: dict[int, int], top: int) -> DataFrame:
    """(item number, score, doc): the best documents of every task."""
    n_docs, n_terms = statistics[-1], statistics[-2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = held.value
        weights = np.zeros(lexicon.n_terms, np.int64)
        for t, df in statistics.items():
            if t >= 0:
                weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        scorer, best = _Scorer(lexicon, weights, n_docs, n_terms), _Best(len(lexicon.items), top)
        block = max(1, min(512, BLOCK_CELLS // len(lexicon.items)))
        lengths, found, ids = [], [], []

        def flush() -> None:
            if found:
                null = np.array([i is None for i in ids])
                best.add(scorer.scores(lengths, found), np.array([NO_ID if i is None else i for i in ids], np.int64), null)
                lengths.clear(), found.clear(), ids.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                n, counted = lexicon.counts(text.as_py())
                if counted:
                    lengths.append(n), found.append(counted), ids.append(doc_id.as_py())
                    if len(found) >= block:
                        flush()
        flush()
        best.prune()
        yield pa.RecordBatch.from_pydict({
            "item": best.item,
            "score": best.score,
            "doc_id": pa.array(best.doc, pa.int64(), mask=best.null),
        })

    return docs.mapInArrow(score, "item long, score long, doc_id long")


def _best_of(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the *top* documents of every item with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in shards(items, item_id, item_text):
        lexicon = Lexicon.of(part)
        if lexicon is None:
            continue
        held = spark.sparkContext.broadcast(lexicon)
        statistics = {r.term: r.n for r in _statistics(read, held).collect()}  # one number a term of the shard
        if not statistics.get(-1):
            continue
        rows = _scored(read, held, statistics, top)
        rows = _best_of(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))), ["item", "part"], top)
        names = spark.createDataFrame(list(enumerate(lexicon.items)), f"item long, item_id {kind}")
        best = _best_of(rows, ["item"], top).join(F.broadcast(names), "item")
        found = found.unionByName(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return found
