"""Exact top-k inner products by block-at-a-time pruning.

Rows are dealt by ranges of vec_id to blocks. A block keeps its vectors (the
forward index) and the greatest and least value of every component (the terms).
For a query, the sum over its components of the greater product with either bound
is at least the score of every row in the block. Neighbouring blocks form a shard,
which one task holds while queries stream past it: it orders the blocks of each
query by that sum, scores block after block and stops where the sum falls below
the query's k-th score so far.

Blocks move twice whatever the number of queries; queries travel. Each is first
sent to the shard whose bounds promise most, and its k-th score there is its floor;
then to the other shards whose bounds reach the floor. The shards' bounds, merged
over neighbours until they are at most BOUND_BYTES together, go to the tasks that
send. The best k of all visits are merged by a window over a query's few rows.

Components x become floor(256 * x), x as double; sums are exact: in doubles while
they are sure to stay below 2**53, else in Python's whole numbers. A score beyond
64 bits raises. Only vectors of equal length are compared.

Defined results: vectors that are null or hold null or non-finite components, and
rows without a vec_id, take no part; rows that repeat a vec_id are candidates of
each other and queries each; equal scores go to the smaller vec_id; an empty table
gives an empty table. Other columns take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from series_rank.session import materialize

BLOCK_ROWS = 256
SHARD_BLOCKS = 256  # at most, and at most so many bytes of values; small tables have about LEAST_SHARDS shards
SHARD_BYTES = 32 << 20
LEAST_SHARDS = 24
GROUP_QUERIES = 512
PARTITION_ROWS = 100_000
BOUND_BYTES = 32 << 20
PARTITIONS = 20_000  # of a search, at most; beyond it tasks hold one shard after another


def _packed(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest of three types."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _unpacked(values: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(values) // max(1, rows * dim), np.float64)
    return np.frombuffer(values, kind).reshape(rows, dim).astype(np.float64)


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    return np.array([_unpacked(v, 1, dim)[0] for v in values]).reshape(len(values), dim)


def _index(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Blocks of up to BLOCK_ROWS rows of equal length in the order of vec_id, numbered in each part and length."""
    sound = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    n = rows.count()
    blocks_a_shard = min(SHARD_BLOCKS, max(1, n // (BLOCK_ROWS * LEAST_SHARDS)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: Counter = Counter()
        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else 0
            by_size: dict[int, list[int]] = {}
            vectors_ = batch["v"]
            sizes = vectors_.value_lengths().to_numpy()
            for i, size in enumerate(sizes.tolist()):
                by_size.setdefault(size, []).append(i)
            for size, own in by_size.items():
                together = min(blocks_a_shard, max(1, SHARD_BYTES // (8 * BLOCK_ROWS * max(1, size))))
                for at in range(0, len(own), BLOCK_ROWS):
                    take = pa.array(own[at : at + BLOCK_ROWS])
                    flat = vectors_.take(take).flatten().to_numpy(zero_copy_only=False)
                    x = np.floor(256 * flat.reshape(len(take), size))
                    ids = batch["id"].take(take).to_numpy()
                    number = numbers[size]
                    numbers[size] += 1
                    row = (part, number // together, size, number, ids, _packed(x), x.min(0), x.max(0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v.tobytes() if i > 3 else v], k) for i, (v, k) in enumerate(zip(row, kinds))], names
                    )

    names = ["part", "shard", "dim", "block", "ids", "values", "least", "most"]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 4
    parts = max(8, -(-n // PARTITION_ROWS))
    # The random number deals rows that share an id; equal rows are candidates like others.
    dealt = rows.withColumn("r", F.rand(5)).repartitionByRange(parts, "id", "r").sortWithinPartitions("id", "r")
    schema = "part int, shard int, dim int, block int, ids binary, values binary, least binary, most binary"
    made = dealt.select("id", "v", F.spark_partition_id().alias("part")).mapInArrow(blocks, schema)
    return materialize(made, "blocks")


class Shard:
    """Some blocks of equal vector length."""

    def __init__(self, blocks: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        self.blocks = blocks
        self.most = np.array([x.max(0) for _, _, _, x in blocks])
        self.least = np.array([x.min(0) for _, _, _, x in blocks])

    def best(self, k: int, queries: np.ndarray, homes: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's best k here, of those that reach its floor; *homes* are the
        queries' own (part, block, place)."""
        n = len(queries)
        exact = np.abs(queries).max(initial=0) * max(np.abs(self.most).max(initial=0), np.abs(self.least).max(initial=0))
        if exact * max(1, queries.shape[1]) >= 2.0**52:
            to = np.vectorize(int, otypes=[object])
            queries = to(queries) if queries.size else queries.astype(object)
            most, least = to(self.most) if self.most.size else self.most, to(self.least) if self.least.size else self.least
        else:
            most, least = self.most, self.least
        whole = queries.dtype == object
        floors = floors if whole else floors.astype(float)
        bound = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
        order = np.argsort(-bound.astype(float), axis=1, kind="stable")
        scores = np.full((n, k), -np.inf, object if whole else float)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        live = np.arange(n)
        for r in range(len(self.blocks)):
            # In the order of the bounds, so a query that stops here has no block left.
            live = live[bound[live, order[live, r]] >= np.maximum(scores[live, -1], floors[live])]
            if not len(live):
                break
            for b in np.unique(order[live, r]):
                own = live[order[live, r] == b]
                part, block, block_ids, x = self.blocks[b]
                if whole:
                    x = np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)
                got = queries[own] @ x.T
                mine = (homes[own, 0] == part) & (homes[own, 1] == block)
                got[np.flatnonzero(mine), homes[own[mine], 2]] = -np.inf
                better = got.max(1) >= np.maximum(scores[own, -1], floors[own])
                own, got = own[better], got[better]
                if not len(own):
                    continue
                all_scores = np.concatenate([scores[own], got], axis=1)
                all_ids = np.concatenate([ids[own], np.broadcast_to(block_ids, (len(own), len(block_ids)))], axis=1)
                top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                scores[own], ids[own] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        return scores, ids


def _runs(batch: pa.RecordBatch, names: list[str], most: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of neighbouring rows that agree in the named columns, of up to *most* rows."""
    keys = list(zip(*(batch[n].to_pylist() for n in names)))
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at] or i - at == most:
            yield keys[at], batch.slice(at, i - at)
            at = i


class Bounds:
    """Greatest and least components of runs of *width* neighbouring shards, by vector length."""

    def __init__(self, index: DataFrame, shards: int) -> None:
        """*index* has gid, the number of the shard, below *shards*."""
        self.shards = shards
        # Every block's own length, so that the sum over the lengths bounds what is collected.
        total = 16 * (index.select("dim").distinct().agg(F.sum("dim").alias("n")).first()["n"] or 0)
        most = max(1, BOUND_BYTES // max(1, total))
        self.width = max(1, -(-shards // most))
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if total > BOUND_BYTES:
            return  # too many lengths: every query is sent to every shard

        def merge(table: pa.Table) -> pa.Table:
            dim, n = table["dim"][0].as_py(), table.num_rows
            least, high = (np.frombuffer(b"".join(table[c].to_pylist()), np.float64).reshape(n, dim) for c in ("least", "most"))
            return pa.table({
                "dim": pa.array([dim], pa.int32()), "run": pa.array([table["run"][0].as_py()], pa.int32()),
                "least": pa.array([least.min(0).tobytes()], pa.binary()), "most": pa.array([high.max(0).tobytes()], pa.binary()),
            })

        merge.__annotations__ = {"table": pa.Table, "return": pa.Table}
        runs = index.select("dim", F.floor(F.col("gid") / self.width).cast("int").alias("run"), "least", "most")
        merged = runs.groupBy("dim", "run").applyInArrow(merge, "dim int, run int, least binary, most binary")
        rows: dict[int, list] = {}
        for r in sorted(merged.collect(), key=lambda r: (r["dim"], r["run"])):  # at most BOUND_BYTES
            rows.setdefault(r["dim"], []).append(r)
        for dim, some in rows.items():
            least, high = (
                np.frombuffer(b"".join(r[c] for r in some), np.float64).reshape(len(some), dim) for c in ("least", "most")
            )
            self.of[dim] = np.array([r["run"] for r in some]), least, high

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs, and for every query and run what a score there cannot exceed."""
        if queries.shape[1] not in self.of:
            runs = np.arange(-(-self.shards // self.width))
            return runs, np.full((len(queries), len(runs)), np.inf)
        runs, least, high = self.of[queries.shape[1]]
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ least.T
        # Sums are exact while all partial sums stay below 2**52; beyond it the bound gets more than their error.
        size = np.abs(queries) @ np.maximum(np.abs(high), np.abs(least)).T
        return runs, np.nan_to_num(bound + np.where(size < 2.0**52, 0, 1e-9 * size), nan=np.inf, posinf=np.inf)


QUERY = ["part", "block", "place", "query_id", "dim", "values"]
QUERY_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
QUERY_SCHEMA = "part int, block int, place int, query_id long, dim int, values binary"


def _queries(index: DataFrame, every: int) -> DataFrame:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                width = len(row["values"]) // len(ids)
                for i in np.flatnonzero(ids % every == 0).tolist():
                    own = row["values"][i * width : (i + 1) * width]
                    rows.append((row["part"], row["block"], i, int(ids[i]), row["dim"], own))
            columns = list(zip(*rows)) or [[] for _ in QUERY]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, QUERY_KINDS)], QUERY)

    return index.select("part", "block", "dim", "ids", "values").mapInArrow(pick, QUERY_SCHEMA)


def _sent(queries: DataFrame, bounds: Bounds, choose: Callable) -> DataFrame:
    """A row for each query and shard to visit; *choose* gives the places of a slice's queries and their shards."""
    together = max(1, min(64, (1 << 21) // bounds.shards))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (dim,), some in _runs(batch, ["dim"], together):
                own, gids = choose(some, *bounds.reach(_matrix(some["values"].to_pylist(), dim)))
                step = max(1, min(10_000, (4 << 20) // (8 * dim + 64)))
                for at in range(0, len(own), step):
                    rows = some.take(pa.array(own[at : at + step]))
                    columns = [*(rows[n] for n in (*QUERY, "floor")), pa.array(gids[at : at + step], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [*QUERY, "floor", "gid"])

    return queries.mapInArrow(send, f"{QUERY_SCHEMA}, floor long, gid int")


def _search(visits: DataFrame, index: DataFrame, shards: int, k: int) -> DataFrame:
    """(part, block, place, dim, query_id, gid, vec_id, score): the best k rows of every visit that reach the floor."""
    names = ["part", "block", "place", "dim", "query_id", "gid", "vec_id", "score"]
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            for key, some in _runs(batch, ["gid", "dim", "is_query"], GROUP_QUERIES):
                (gid, dim, is_query) = key
                if not is_query:
                    if now != (gid, dim):
                        now, held, shard = (gid, dim), [], None
                    for row in some.to_pylist():
                        ids = np.frombuffer(row["ids"], np.int64)
                        held.append((row["part"], row["block"], ids, _unpacked(row["values"], len(ids), dim)))
                    continue
                if now != (gid, dim):
                    continue  # the shard has no vectors of this length
                shard = shard or Shard(held)
                homes = np.column_stack([some[c].to_numpy() for c in ("part", "block", "place")])
                floors = np.array([-np.inf if f is None else f for f in some["floor"].to_pylist()], object)
                scores, ids = shard.best(k, _matrix(some["values"].to_pylist(), dim), homes, floors)
                own, place = np.nonzero((scores != -np.inf) & (scores >= floors[:, None]))
                rows = some.take(pa.array(own))
                score = pa.array([int(v) for v in scores[own, place].tolist()], pa.int64())
                columns = [*(rows[n] for n in names[:6]), pa.array(ids[own, place]), score]
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = index.withColumns({
        "place": F.lit(None).cast("int"), "query_id": F.lit(None).cast("long"), "floor": F.lit(None).cast("long"),
        "is_query": F.lit(False),
    }).drop("least", "most", "shard")
    both = blocks.unionByName(visits.withColumns({"ids": F.lit(None).cast("binary"), "is_query": F.lit(True)}))
    partitions = min(shards, PARTITIONS)
    dealt = both.repartitionById(partitions, F.pmod("gid", F.lit(partitions)).cast("int"))
    schema = "part int, block int, place int, dim int, query_id long, gid int, vec_id long, score long"
    return dealt.sortWithinPartitions("gid", "dim", "is_query").mapInArrow(stream, schema)


def _first(some: pa.RecordBatch, runs: np.ndarray, bound: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of the run of greatest bound."""
    return np.arange(len(bound)), runs[bound.argmax(1)] * bounds.width


def _others(some: pa.RecordBatch, runs: np.ndarray, bound: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """All shards whose bound reaches the query's floor, without the one that it has visited."""
    floors = np.array([-np.inf if f is None else f for f in some["floor"].to_pylist()], float)
    own, at = np.nonzero(bound >= floors[:, None])
    own = np.repeat(own, bounds.width)
    gids = (runs[at][:, None] * bounds.width + np.arange(bounds.width)).ravel()
    new = (gids < bounds.shards) & (gids != some["first"].to_numpy()[own])
    return own[new], gids[new]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the best k rows for each row whose id is divisible by *every*."""
    index = _index(vectors, vec_id, embedding)
    size = index.agg(F.max("part").alias("parts"), F.max("shard").alias("shards")).first()
    each = (size["shards"] or 0) + 1
    shards = ((size["parts"] or 0) + 1) * each
    index = index.withColumn("gid", (F.col("part") * each + F.col("shard")).cast("int"))
    bounds = Bounds(index, shards)

    queries = _queries(index, every).withColumn("floor", F.lit(None).cast("long"))
    sent = _sent(queries, bounds, lambda *slice_: _first(*slice_, bounds))
    begun = materialize(sent, "queries")
    found = materialize(_search(begun, index, shards, k), "first_visits")
    query = ["part", "block", "place", "dim"]
    kth = found.groupBy(*query).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    floors = begun.drop("floor").withColumnRenamed("gid", "first").join(kth.drop("n"), query, "left").withColumnRenamed("s", "floor")
    visits = _sent(floors, bounds, lambda *slice_: _others(*slice_, bounds))
    rest = _search(visits, index, shards, k)

    best = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
