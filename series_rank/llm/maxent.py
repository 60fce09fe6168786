"""Language-model scores of a hashed maximum-entropy model.

The probability of a word in its context is factored over classes:

    P(word | context) = P(class | context) * P(slot | class, context) * share of the word in its slot

Classes and slots come from the word's hash; both choices are softmaxes over
summed weights of hashed features: the word before, the two words before, and the
skip over one word. Weights start from the class and slot frequencies, so the
untrained model is a unigram model, and each round adds one gradient step over
its part of the training rows: every task sums the gradients of all its tokens,
Spark adds the tasks' sums by slices of the weights, and the driver holds the
weights alone, whose size is fixed. Steps are scaled by each weight's curvature.

Word counts of the corpus are kept as a table by key range (exchange.py), however
many words there are; the texts to be scored ask it by chunk.

A text is its words, ASCII letters in lower case, and one end token. The held-out
rows (crc32 of the doc_id as text, modulo 10, is 0) take no part in learning.

Defined results: a null or empty text is its end token; a null doc_id counts as
empty text, hence as held out; repeated rows are learnt and scored each; without
any training token all counts are 0 and the weights stay 0; an empty table gives
an empty table. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.llm.caches import only
from series_rank.llm.exchange import Deal, added, chunked, cut_by_range, deal, requests, resolved
from series_rank.llm.words import hash_texts, mix
from series_rank.session import materialize

CLASSES = SLOTS = 16
CLASS_ROWS = 1 << 14
SLOT_ROWS = 1 << 16
FEATURES = 3
ROUNDS = 2
STEP = 1.0 / FEATURES
PRIOR = 20.0  # tokens' worth of curvature added to every weight
SMOOTHING = 0.1
SLICE = 1 << 12
BATCH = 1 << 13  # tokens whose arrays fit a core's cache
END = mix(np.zeros(1, np.uint64) + np.uint64(97))[0]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def cells(keys: np.ndarray) -> np.ndarray:
    """Class * SLOTS + slot of each key."""
    return (keys >> np.uint64(56)).astype(np.int64)


@dataclass
class Model:
    class_bias: np.ndarray
    slot_bias: np.ndarray
    class_weights: np.ndarray
    slot_weights: np.ndarray
    cell_tokens: np.ndarray
    cell_words: np.ndarray

    @classmethod
    def start(cls, cell_tokens: np.ndarray, cell_words: np.ndarray) -> Model:
        mass = (cell_tokens + SMOOTHING * (cell_words + 1)).reshape(CLASSES, SLOTS)
        return cls(
            np.log(mass.sum(1)).astype(np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
            np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32),
            cell_tokens, cell_words,
        )

    def features(self, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Feature hashes of each token of joined documents, which begin at *begins*."""
        before = np.concatenate(([END], keys[:-1]))
        before[begins] = END
        skip = np.concatenate(([END], before[:-1]))
        skip[begins] = END
        both = mix(skip * np.uint64(3) ^ before)
        return np.stack([mix(before ^ np.uint64(11)), both, mix(skip ^ np.uint64(37))])

    def forward(self, f: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of weights and both softmaxes (the slot's within the true class)."""
        cls = cell // SLOTS
        rows = (f % np.uint64(CLASS_ROWS)).astype(np.uint16)
        srows = (mix(f + cls.astype(np.uint64)) % np.uint64(SLOT_ROWS)).astype(np.uint16)
        a = _softmax(_summed(self.class_bias[None].repeat(len(cell), 0), self.class_weights, rows))
        b = _softmax(_summed(self.slot_bias.take(cls, 0), self.slot_weights, srows))
        return rows, srows, a, b

    def log10(self, keys: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probability of each token, whose training count is given."""
        out = np.empty(len(keys))
        f, cell = self.features(keys, begins), cells(keys)
        for at in range(0, len(keys), BATCH):
            s = slice(at, at + BATCH)
            _, _, a, b = self.forward(f[:, s], cell[s])
            i = np.arange(len(a))
            share = (counts[s] + SMOOTHING) / (self.cell_tokens[cell[s]] + SMOOTHING * (self.cell_words[cell[s]] + 1))
            chosen = a[i, cell[s] // SLOTS].astype(float) * b[i, cell[s] % SLOTS]
            out[s] = np.log10(chosen * share)
        return out


def _summed(start: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    for r in rows:
        start += weights.take(r, 0)
    return start


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


class Gradient:
    """Sums of residuals by weight row, with the number of tokens that used the row in the last column."""

    def __init__(self) -> None:
        self.sums = {"class": np.zeros((CLASS_ROWS, CLASSES + 1)), "slot": np.zeros((SLOT_ROWS, SLOTS + 1))}

    def add(self, model: Model, keys: np.ndarray, begins: np.ndarray) -> None:
        f, cell = model.features(keys, begins), cells(keys)
        for at in range(0, len(keys), BATCH):
            s = slice(at, at + BATCH)
            rows, srows, a, b = model.forward(f[:, s], cell[s])
            i = np.arange(len(a))
            for name, used, p, true in (("class", rows, a, cell[s] // SLOTS), ("slot", srows, b, cell[s] % SLOTS)):
                residual = np.empty((len(p), p.shape[1] + 1), np.float32)
                np.negative(p, out=residual[:, :-1])
                residual[i, true] += 1
                residual[:, -1] = 1
                for r in used:
                    order = np.argsort(r, kind="stable")  # 16 bits: a radix sort
                    held = r[order]
                    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
                    self.sums[name][held[first]] += np.add.reduceat(residual.take(order, 0), first)

    def slices(self) -> Iterator[tuple[str, int, bytes]]:
        for name, table in self.sums.items():
            for at in range(0, len(table), SLICE):
                yield name, at, table[at : at + SLICE].astype(np.float32).tobytes()


def _joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some texts (words, then the end), where each begins, and how many each has."""
    each = hash_texts([(t or b"").lower() for t in texts])
    sizes = np.array([len(e) + 1 for e in each], np.int64)
    end = np.array([END])
    return np.concatenate([x for e in each for x in (e, end)]), np.cumsum(sizes) - sizes, sizes


def vocabulary(train: DataFrame, sizes: Deal) -> DataFrame:
    """(range, keys, counts, tokens, words): the counts of all training tokens by key range, with
    arrays of the tokens and distinct words of each cell."""
    ranges = sizes.ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            texts = batch["text"].to_pylist()
            if not texts:
                continue
            keys, counts = np.unique(_joined(texts)[0], return_counts=True)
            parts = cut_by_range(keys, ranges)
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in parts], pa.int32()),
                pa.array([keys[a:b].tobytes() for _, a, b in parts], pa.binary()),
                pa.array([counts[a:b].astype(np.int64).tobytes() for _, a, b in parts], pa.binary()),
            ], ["range", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys, totals, _, _ = added(table, "int64")
        cell = cells(keys)
        return pa.table({
            "range": pa.array([table["range"][0].as_py()], pa.int32()),
            "keys": pa.array([keys.tobytes()], pa.binary()),
            "counts": pa.array([totals.tobytes()], pa.binary()),
            "tokens": pa.array([np.bincount(cell, totals, CLASSES * SLOTS).astype(np.int64)], pa.list_(pa.int64())),
            "words": pa.array([np.bincount(cell, minlength=CLASSES * SLOTS)], pa.list_(pa.int64())),
        })

    add.__annotations__ = {"table": pa.Table, "return": pa.Table}
    asked = train.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "range int, keys binary, counts binary")
    return asked.repartitionById(ranges, F.col("range")).groupBy("range").applyInArrow(
        add, "range int, keys binary, counts binary, tokens array<long>, words array<long>"
    )


def cell_totals(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every cell."""
    pairs = words.select(F.posexplode(F.arrays_zip("tokens", "words")).alias("cell", "t"))
    out = np.zeros((2, CLASSES * SLOTS), np.int64)
    for r in pairs.groupBy("cell").agg(F.sum("t.tokens").alias("n"), F.sum("t.words").alias("v")).collect():
        out[:, r["cell"]] = r["n"], r["v"]
    return out[0], out[1]


def gradient(train: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """The gradient over all rows, added up by slices of the weights."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        total = Gradient()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), 256):
                keys, begins, _ = _joined(texts[at : at + 256])
                total.add(model, keys, begins)
        names, at, blobs = zip(*total.slices())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["name", "at", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table["sums"].to_pylist())
        return pa.table({
            "name": table["name"].slice(0, 1), "at": table["at"].slice(0, 1),
            "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
        })

    add.__annotations__ = {"table": pa.Table, "return": pa.Table}
    schema = "name string, at int, sums binary"
    parts = train.select(F.col("text").cast("binary").alias("text")).mapInArrow(sum_up, schema)
    out = {"class": np.zeros((CLASS_ROWS, CLASSES + 1)), "slot": np.zeros((SLOT_ROWS, SLOTS + 1))}
    for r in parts.groupBy("name", "at").applyInArrow(add, schema).collect():
        table = out[r["name"]]
        table[r["at"] : r["at"] + SLICE] = np.frombuffer(r["sums"], np.float32).reshape(-1, table.shape[1])
    return out


def updated(model: Model, sums: dict[str, np.ndarray]) -> Model:
    """One step, scaled by the curvature that the weights have at the mean probabilities."""
    spread = _softmax(model.class_bias[None])[0]
    inner = np.exp(model.slot_bias).T @ spread
    for weights, g, p in ((model.class_weights, sums["class"], spread), (model.slot_weights, sums["slot"], inner)):
        weights += (STEP * g[:, :-1] / (g[:, -1:] * (p * (1 - p)) + PRIOR)).astype(np.float32)
    return model


def fit(train: DataFrame, cell_tokens: np.ndarray, cell_words: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model after *rounds* steps, each over its own part of the training rows, all of them once."""
    model = Model.start(cell_tokens, cell_words)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for k in range(rounds if cell_tokens.sum() else 0):
        model = updated(model, gradient(train.where(part == k), model))
    return model


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    slim = docs.select("doc_id", "text")
    sizes = deal(slim)
    train = slim.where(~held_out())
    words = materialize(vocabulary(train, sizes), "vocabulary")
    cell_tokens, cell_words = cell_totals(words)
    model = fit(train, cell_tokens, cell_words, rounds)
    n, v = int(cell_tokens.sum()), int(cell_words.sum())

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(_joined(table["text"].to_pylist())[0])
        return keys, np.empty(0, np.uint8)

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        empty = not known.num_rows
        keys = np.frombuffer(b"" if empty else known["keys"][0].as_py(), np.uint64)
        counts = np.append(np.frombuffer(b"" if empty else known["counts"][0].as_py(), np.int64), 0)
        out = []
        for blob in asked["keys"].to_pylist() if asked.num_rows else []:
            want = np.frombuffer(blob, np.uint64)
            at = np.searchsorted(keys, want)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == want[hit]
            out.append(np.where(hit, counts[np.where(hit, at, len(keys))], 0).tobytes())
        return pa.table({
            "chunk": asked["chunk"].cast(pa.int64()) if asked.num_rows else pa.array([], pa.int64()),
            "range": asked["range"].cast(pa.int32()) if asked.num_rows else pa.array([], pa.int32()),
            "totals": pa.array(out, pa.binary()),
        })

    def use(table: pa.Table, totals: bytes) -> pa.Table:
        keys, begins, lengths = _joined(table["text"].to_pylist())
        _, place = np.unique(keys, return_inverse=True)
        counts = np.frombuffer(totals, np.int64)[place]
        base = np.log10((counts + SMOOTHING) / (n + SMOOTHING * (v + 1)))
        return pa.table({
            "doc_id": table["doc_id"],
            "held_out": table["held_out"],
            "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), begins), pa.int64()),
            "train_tokens": pa.array([n] * len(lengths), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, begins)),
            "score": pa.array(np.add.reduceat(model.log10(keys, begins, counts), begins)),
        })

    look_up.__annotations__ = {"asked": pa.Table, "known": pa.Table, "return": pa.Table}
    rows = slim.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    dealt = chunked(rows, ["doc_id", "text"], sizes)
    asked = requests(dealt, sizes, keys_of).drop("counts").repartitionById(sizes.ranges, F.col("range"))
    known = words.select("range", "keys", "counts").repartitionById(sizes.ranges, F.col("range"))
    replies = asked.groupBy("range").cogroup(known.groupBy("range")).applyInArrow(
        look_up, "chunk long, range int, totals binary"
    )
    return resolved(
        dealt, replies, sizes, use,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
