"""Token-id files with a shared zstandard dictionary.

Documents are dealt by ranges of doc_id to shards. A task sorts its shard and
writes it as blocks: a header, an index (doc_id, ids, offset of every document)
and the documents' ids, each compressed by itself with the shared dictionary, so
that one short document can be read without its neighbours. Blocks are written by
Spark as rows of one binary column beside the range of doc_ids they hold, which
needs no file system but Spark's, commits whole tasks, and lets a reader of some
documents skip the other blocks. The header names the dictionary by its hash; the
dictionary lies beside the blocks.

The dictionary is trained on the ids of at most SAMPLE_DOCS documents, the ones
with the least hashes of their ids, and at most SAMPLE_IDS ids of each, in runs
spread evenly over a longer one. Where that is too little to train on, a warning
says so and the documents are compressed without a dictionary.

Defined results: a null text is an empty document with its end id alone; rows
without a doc_id come first; rows with the same doc_id are kept each, by their
texts' order; an empty table gives no blocks. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import struct
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from series_rank.llm.segments import encoder, slices
from series_rank.session import scratch_path

SAMPLE_DOCS = 1_000
SAMPLE_IDS = 8_192
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 32 << 20  # of text
BLOCK_DOCS = 512
BLOCK_IDS = 1 << 22
LEVEL = 1
HEADER = struct.Struct("<4sHH32sq")  # magic, version, bytes an id, dictionary hash, documents
MAGIC, VERSION = b"TIDS", 1
NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Dictionary:
    content: bytes

    @property
    def hash(self) -> bytes:
        return hashlib.sha256(self.content).digest()

    def zstd(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.content) if self.content else None


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> Dictionary:
    """A dictionary of serialized id arrays; too few samples for one give the empty dictionary, and a warning."""
    try:
        return Dictionary(zstandard.train_dictionary(size, samples).as_bytes())
    except zstandard.ZstdError as error:
        warnings.warn(f"no dictionary could be trained on {len(samples)} documents: {error}", stacklevel=2)
        return Dictionary(b"")


def spread(ids: np.ndarray, most: int = SAMPLE_IDS, runs: int = 16) -> np.ndarray:
    """At most that many ids, from runs at even distances."""
    if len(ids) <= most:
        return ids
    starts = np.linspace(0, len(ids) - most // runs, runs).astype(np.int64)
    return np.concatenate([ids[s : s + most // runs] for s in starts])


@lru_cache(maxsize=2)
def _codec(content: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    shared = Dictionary(content).zstd()
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write_block(docs: list[tuple[int | None, np.ndarray]], dictionary: Dictionary, width: int) -> bytes:
    """The block of (doc_id, ids) in their order; *width* bytes an id."""
    pack, kind = _codec(dictionary.content)[0], f"<u{width}"
    frames = [pack.compress(ids.astype(kind).tobytes()) for _, ids in docs]
    index = np.zeros((3, len(docs)), "<i8")
    index[0] = [NO_ID if d is None else d for d, _ in docs]
    index[1] = [len(ids) for _, ids in docs]
    index[2] = np.cumsum([0, *map(len, frames)])[:-1]
    return HEADER.pack(MAGIC, VERSION, width, dictionary.hash, len(docs)) + index.tobytes() + b"".join(frames)


class Block:
    """A block's index, and its documents on request."""

    def __init__(self, image: bytes, dictionary: Dictionary) -> None:
        magic, version, width, used, n = HEADER.unpack_from(image)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a block of token ids")
        if used != dictionary.hash:
            raise ValueError("the block was written with another dictionary")
        at = HEADER.size
        self.doc_ids, self.sizes, self.offsets = np.frombuffer(image, "<i8", 3 * n, at).reshape(3, n)
        self.data, self.kind = memoryview(image)[at + 24 * n :], f"<u{width}"
        self.unpack = _codec(dictionary.content)[1]

    def ids(self, i: int) -> np.ndarray:
        end = self.offsets[i + 1] if i + 1 < len(self.offsets) else len(self.data)
        return np.frombuffer(self.unpack.decompress(self.data[self.offsets[i] : end]), self.kind)


def _encode(texts: list, tokenizer: str, end_id: int) -> Iterator[np.ndarray]:
    end = np.array([end_id], "<u4").tobytes()
    for raw in encoder(tokenizer, drops_space=True).encode(texts):
        yield np.frombuffer(raw + end, "<u4")


def sample(docs: DataFrame, tokenizer: str, end_id: int, width: int, most: int = SAMPLE_DOCS) -> list[bytes]:
    """Serialized ids of the documents the dictionary is trained on."""
    drawn = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = _encode(batch.to_pylist(), tokenizer, end_id)
            yield pa.array([spread(a).astype(f"<u{width}").tobytes() for a in made], pa.binary())

    ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn.distinct()), "doc_id", "left_semi")  # at most *most* ids
    made = texts.select("doc_id", F.arrow_udf(ids, "binary")(F.col("text").cast("string")).alias("ids"))
    return [r["ids"] for r in made.limit(most).collect()]


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, width: int = 2, shard_bytes: int = SHARD_BYTES
) -> None:
    """Write the blocks of *docs* and their dictionary under *path*, in the order of doc_id."""
    spark = docs.sparkSession
    dictionary = train(sample(docs, tokenizer, end_id, width))
    content = dictionary.content
    named = spark.createDataFrame([(dictionary.hash.hex(), bytearray(content))], "hash string, content binary")
    named.write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        load, block, shard = 0, 0, 0

        def flush() -> pa.RecordBatch:
            own = [d for d, _ in held if d is not None]
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()),
                pa.array([min(own, default=None)], pa.int64()), pa.array([max(own, default=None)], pa.int64()),
                pa.array([sum(len(ids) for _, ids in held)], pa.int64()),
                pa.array([write_block(held, Dictionary(content), width)], pa.binary()),
            ], ["shard", "block", "first_id", "last_id", "n_tokens", "image"])

        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            if doc_ids:
                shard = batch["shard"][0].as_py()
            for some, own in zip(slices(texts), slices(doc_ids)):
                for doc_id, ids in zip(own, _encode(some, tokenizer, end_id)):
                    held.append((doc_id, ids))
                    load += len(ids)
                    if len(held) == BLOCK_DOCS or load >= BLOCK_IDS:
                        yield flush()
                        held, load, block = [], 0, block + 1
        if held:
            yield flush()

    n = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sorted_ = slim.repartitionByRange(max(1, -(-n // shard_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard int, block int, first_id long, last_id long, n_tokens long, image binary"
    numbered = sorted_.withColumn("shard", F.spark_partition_id())
    numbered.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(bytes(spark.read.parquet(f"{path}/dictionary").first()["content"]))


def _documents(table: DataFrame, content: bytes, wanted: frozenset[int] | None, with_ids: bool) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, image in zip(*(batch[c].to_pylist() for c in ("shard", "block", "image"))):
                block = Block(image, Dictionary(content))
                starts = np.cumsum(block.sizes) - block.sizes
                rows = []
                for i, doc_id in enumerate(block.doc_ids.tolist()):
                    if wanted is None or doc_id in wanted:
                        ids = block.ids(i).astype("<u4")
                        row = (shard, number, None if doc_id == NO_ID else doc_id, int(starts[i]), len(ids), zlib.crc32(ids))
                        rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                columns = list(zip(*rows)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4] + [pa.list_(pa.int32())] * with_ids
    schema = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return table.select("shard", "block", "image").mapInArrow(read, schema)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document; start counts the ids before it."""
    table = spark.read.parquet(f"{path}/blocks")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a shard: as many as partitions written
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("shard").orderBy("block")), F.lit(0))
    places = table.select("shard", "block", within.alias("within")).join(shards, "shard")
    docs = _documents(table, _dictionary(spark, path).content, None, with_ids)
    start = F.col("base") + F.col("within") + F.col("at")
    out = docs.join(places, ["shard", "block"]).withColumn("start", start)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_some(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: other blocks are skipped, other documents not unpacked."""
    near = F.lit(False)
    for d in doc_ids:
        near = near | F.lit(d).between(F.col("first_id"), F.col("last_id"))
    table = spark.read.parquet(f"{path}/blocks").where(near)
    found = _documents(table, _dictionary(spark, path).content, frozenset(doc_ids), True)
    return found.select("doc_id", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write *docs* into the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
