"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are encoded by the tokenizers library (see segments.py) with a model built
from a rank file. A token is a run of bytes, so its place in the text follows
from the lengths of the tokens before it; a byte-to-character map turns that into
offsets in characters. A token that starts or ends inside a character covers the
whole character. Decoding looks up every id's bytes and joins them before it
reads UTF-8, so that characters split over tokens come back.

Defined results: a null text is an empty one; repeated rows give repeated rows;
other columns pass through, except those named like the new ones, which the new
ones replace. Ids without bytes, null ones included, raise; a null list decodes to no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from series_rank.llm.segments import encoder, ranks_of


SLICE_CHARS = 1 << 20  # of texts whose tokens are placed together; a longer text is placed by itself


@lru_cache(maxsize=4)
def byte_table(path: str) -> pa.Array:
    """The bytes of every id, null where there is none."""
    ranks = ranks_of(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    return np.array([len(t or b"") for t in byte_table(path).to_pylist()], np.int64)


def offsets(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in characters of tokens of these byte lengths."""
    ends = np.cumsum(lengths)
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(first)))  # characters begun before each byte
    starts = ends - lengths
    inside = np.append(~first, False)[starts]
    return chars[starts] - inside, chars[ends]


def token_lists(texts: list[str | None], model, lengths: np.ndarray | None) -> dict[str, pa.Array]:
    """Ids of the texts, one list each, and with *lengths* the starts and ends of the tokens in characters."""
    raw = model.encode(texts)
    ids = np.frombuffer(b"".join(raw), "<u4")
    bounds = np.cumsum([0, *(len(r) // 4 for r in raw)])
    made = {"ids": ids}
    if lengths is not None:
        starts, ends = offsets("".join(t or "" for t in texts).encode(), lengths[ids])
        begun = np.repeat(np.cumsum([0, *(len(t or "") for t in texts)])[:-1], np.diff(bounds))
        made |= {"starts": starts - begun, "ends": ends - begun}
    cuts = pa.array(bounds, pa.int32())
    return {n: pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for n, x in made.items()}


def runs(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """Neighbouring texts, up to *most* characters at a time."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text or "") > most:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text or "")
    if some:
        yield some


def encoded(
    docs: DataFrame, path: str, pattern: str, text: str = "text", with_offsets: bool = False, with_decoded: bool = False
) -> DataFrame:
    """*docs* with ids (array of int) and, if asked for, the starts and ends of the tokens in
    characters and the bytes that the ids decode to, made in the same Python worker."""
    kinds = {"ids": "array<int>"}
    if with_offsets:
        kinds |= {"starts": "array<int>", "ends": "array<int>"}
    if with_decoded:
        kinds["decoded"] = "binary"
    names = list(kinds)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, table = encoder(path, pattern), byte_table(path)
        lengths = byte_lengths(path) if with_offsets else None
        for batch in batches:
            for some in runs(batch.to_pylist()):
                lists = token_lists(some, model, lengths)
                if with_decoded:
                    lists["decoded"] = decoded_lists(lists["ids"], table)
                yield pa.StructArray.from_arrays([lists[n] for n in names], names)

    made = F.arrow_udf(_typed(encode), "struct<" + ",".join(f"{n}: {k}" for n, k in kinds.items()) + ">")
    return _with_fields(docs, made(F.col(text).cast("string")), names)


def decoded(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """*rows* with the bytes of their ids; cast them to string for the text."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = byte_table(path)
        for batch in batches:
            yield decoded_lists(batch, table)

    return rows.withColumn(into, F.arrow_udf(_typed(decode), "binary")(F.col(ids)))


def decoded_lists(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The joined bytes of each list's ids, which lie behind one another once all tokens are taken."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    tokens = table.take(lists.flatten())
    if tokens.null_count:
        raise ValueError("an id without bytes")
    if not len(tokens):
        return pa.array([b""] * len(lists), pa.binary())
    places = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    bounds = places[np.concatenate(([0], np.cumsum(counts)))]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), tokens.buffers()[2]])


def _with_fields(docs: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """*docs* and the fields of a struct, in place of columns of their names."""
    old = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in old)).alias("row"), made.alias("made"))
    return rows.select(*(F.col(f"row.`{c}`") for c in old), *(F.col(f"made.{n}") for n in names))


def _typed(f):
    """Iterator form for arrow_udf, whose annotations must be types and not text."""
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f
