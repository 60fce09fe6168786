"""Best-fit packing of tokenized documents by exact-complement hashing.

Only the number of pieces of each length matters for a packing, and there are at
most *capacity* lengths, so the plan is made from that histogram: its size and
the driver's work depend on the capacity alone. The plan is a list of patterns
(lengths that share a sequence, and how many sequences have that form). Every
piece gets its rank among the pieces of its length; ranges of ranks point to
places in patterns. Ranks come from counts per (length, salt), so a length that
holds any part of the rows is never ranked in one task.

Defined results: a null text is an empty document, which holds the end id alone;
repeated rows are packed each; an empty table gives an empty table. Other columns
take no part. Pieces are cut from the end, so only a document's first piece is
shorter than the capacity.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from series_rank.llm.segments import encoder, slices
from series_rank.session import materialize

CAPACITY = 2048
ROWS_PER_RANKING = 500_000

Pattern = tuple[list[int], int]


class Sums:
    """Available lengths with indexes of the combinations of two and three by their sums.

    pairs[s] lists the longer lengths of the pairs that add up to s, triples[s] the
    longest lengths of the triples, each ascending; the rest of a triple is a pair.
    There are at most about capacity**2 / 4 pairs and 0.7 * capacity**2 entries of
    triples. What is used up never comes back, so used-up entries leave at the end
    where they are looked up, once each.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        have = [x for x in range(1, capacity + 1) if self.left[x]]
        self.pairs: list[list[int]] = [[] for _ in range(capacity + 1)]
        for a in have:
            for b in have[: bisect_right(have, min(a, capacity - a))]:
                self.pairs[a + b].append(a)
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        sums = [s for s in range(2, capacity + 1) if self.pairs[s]]
        for a in have:
            for rest in sums[: bisect_right(sums, min(2 * a, capacity - a))]:
                self.triples[a + rest].append(a)

    def fit(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def live_pairs(self, total: int) -> list[int]:
        some = self.pairs[total]
        while some and not self.fit([some[-1], total - some[-1]]):
            some.pop()
        return some

    def pair(self, gap: int, held: list[int]) -> list[int] | None:
        for a in reversed(self.live_pairs(gap)):
            if self.fit([*held, a, gap - a]):
                return [a, gap - a]
        return None

    def triple(self, gap: int, held: list[int]) -> list[int] | None:
        some = self.triples[gap]
        while some and not (self.left[some[-1]] and self.live_pairs(gap - some[-1])):
            some.pop()
        for a in reversed(some):
            if self.fit([*held, a]) and (rest := self.pair(gap - a, [*held, a])):
                return [a, *rest]
        return None

    def filling(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three available lengths beside *held* that add up to *gap*."""
        if self.fit([*held, gap]):
            return [gap]
        return self.pair(gap, held) or self.triple(gap, held)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (lengths, number of sequences) that use every piece once."""
    sums = Sums(counts, capacity)
    out: list[Pattern] = []
    rest: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        while n := sums.left[length]:
            if length == capacity:
                out.append(([length], n))
                sums.left[length] = 0
                continue
            others = sums.filling(capacity - length, [length])
            if others is None:
                sums.left[length] = 0
                rest.append((length, n))
                continue
            need = Counter([length, *others])
            times = min(sums.left[x] // k for x, k in need.items())
            for x, k in need.items():
                sums.left[x] -= k * times
            out.append(([length, *others], times))
    return out + best_fit(rest, capacity)


def best_fit(pieces: list[tuple[int, int]], capacity: int) -> list[Pattern]:
    """Best-fit decreasing for (length, count) in descending order of length."""
    bins: dict[int, list[Pattern]] = {}  # by gap
    gaps: list[int] = []

    def put(lengths: list[int], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((lengths, times))

    for length, n in pieces:
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put([length] * each, n // each)
                if n % each:
                    put([length] * (n % each), 1)
                n = 0
                continue
            gap = gaps[at]
            lengths, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            each = min(gap // length, n)
            used = min(times, n // each)
            if used < times:
                put(lengths, times - used)
            put(lengths + [length] * each, used)
            n -= each * used
    return [x for some in bins.values() for x in some]


def places(patterns: list[Pattern]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length: first ranks of its ranges, the sequence of the first rank, the offset; and the sequences."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for lengths, times in patterns:
        at = 0
        for length in lengths:
            ranges.setdefault(length, []).append((taken[length], base, at))
            taken[length] += times
            at += length
        base += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranges.items()}, base


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_ids, texts in zip(slices(batch["doc_id"].to_pylist()), slices(batch["text"].to_pylist())):
                rows = []
                for doc_id, raw in zip(doc_ids, model.encode(texts)):
                    raw += end
                    first = (len(raw) // 4 - 1) % capacity + 1
                    at = 0
                    for piece, stop in enumerate(range(4 * first, len(raw) + 1, 4 * capacity)):
                        part = raw[at:stop]
                        row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
                        at = stop
                columns = list(zip(*rows)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, schema)


def assigned(table: DataFrame, capacity: int = CAPACITY, rows_per_ranking: int = ROWS_PER_RANKING) -> DataFrame:
    """*table* (with doc_id, piece, start, length and _deal) with sequence_id and offset in place of _deal; it is read
    three times. _deal is a random number saved with the row, so that equal rows are ranked in different tasks too."""
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where, _ = places(plan(histogram, capacity))
    salts = max(1, max(histogram.values(), default=0) // rows_per_ranking + 1) if histogram else 1
    salts = max(salts, 8)
    salted = table.withColumn("_salt", F.pmod("_deal", F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(
            Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    bases = sizes.select("length", "_salt", before.alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(bases, ["length", "_salt"])

    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, rank in batches:
            length, rank = length.to_numpy(), rank.to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, base, at = where[int(x)]
                r = np.searchsorted(first, rank[own], "right") - 1
                seq[own], off[own] = base[r] + rank[own] - first[r], at[r]
            yield pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    place.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(place, "struct<sequence_id: bigint, offset: bigint>")
    out = ranked.withColumn("_place", made(F.col("length"), F.col("_base") + F.col("_rank")))
    return out.select(*(c for c in table.columns if c != "_deal"), "_place.sequence_id", "_place.offset")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Every piece with its place; the texts are tokenized once, into the shared folder."""
    dealt = pieces(docs, tokenizer, end_id, capacity, with_ids).withColumn("_deal", (F.rand(17) * (1 << 31)).cast("int"))
    table = materialize(dealt, "pieces")
    return assigned(table, capacity)
