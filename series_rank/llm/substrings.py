"""Substring deduplication: passages that repeat, found by counting every window.

The Rabin-Karp hash of every window of *width* words is counted over the corpus
(see exchange.py). A window whose hash starts more than once, in the same
document or elsewhere, marks its words; marked runs are maximal removal
intervals. All windows are judged on the input, so every occurrence goes.

Equal sequences always have equal hashes. Different ones share one of the 2**64
with a probability of about n**2 / 2**65 for n windows.

Defined results: a null text has no words and stays null; texts shorter than a
window lose nothing; repeated rows repeat each other's windows; an empty table
gives an empty table; all columns pass through whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.llm.exchange import answers, chunked, deal, requests, resolved
from series_rank.llm.words import covered, hash_texts, window_hashes

WIDTH = 35
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first word, word behind the last) of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without its runs of words and the white space behind each; the rest unchanged."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, stop in runs:
        out.append(text[at : spans[first][0]])
        at = spans[stop][0] if stop < len(spans) else len(text)
    return b"".join([*out, text[at:]])


def _texts(table: pa.Table, column: str) -> list[bytes]:
    return [t or b"" for t in table[column].to_pylist()]


def _windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    return [window_hashes(h, width) for h in hash_texts(texts)]


def repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", keep_layout: bool = False) -> DataFrame:
    """(row, n_words, intervals, kept) of every row.

    row is a struct of all columns, with the text that stays in its place; intervals are runs of removed words; kept is
    the text of the words that stay, joined by one space, or with *keep_layout*
    the original text without the runs.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = columns[docs.columns.index(text)]
    kinds = docs.schema
    rows = docs.toDF(*columns).withColumn("_text", F.col(at).cast("binary")).drop(at)
    others = [c for c in columns if c != at]
    sizes = deal(docs, text)
    dealt = chunked(rows, [*_hashable(kinds, columns, at), "_text"], sizes)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = _windows(_texts(table, "_text"), width)
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        return keys, np.minimum(counts, 2).astype(np.uint8)

    def use(table: pa.Table, totals: bytes) -> pa.Table:
        texts = _texts(table, "_text")
        found = _windows(texts, width)
        keys, place = np.unique(np.concatenate(found), return_inverse=True)
        again = np.frombuffer(totals, np.uint8) > 1
        if len(again) != len(keys):
            raise ValueError("a chunk's answers do not fit its windows")
        flags = np.split(again[place], np.cumsum([len(f) for f in found])[:-1])
        n_words, runs, kept = [], [], []
        for t, flag in zip(texts, flags):
            words = t.split()
            mask = covered(np.flatnonzero(flag), width, len(words)) if flag.any() else None
            own = [] if mask is None else intervals(mask)
            n_words.append(len(words))
            runs.append([{"start": a, "stop": b} for a, b in own])
            if keep_layout:
                kept.append(without(t, own) if own else t)
            else:
                kept.append(b" ".join(words if mask is None else [words[i] for i in np.flatnonzero(~mask)]))
        out = table.select([c for c in table.column_names if c in others])
        for name, values, kind in (
            ("n_words", n_words, pa.int64()),
            ("intervals", runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("kept", kept, pa.binary()),
            ("_null", [not v.is_valid for v in table["_text"]], pa.bool_()),
        ):
            out = out.append_column(name, pa.array(values, kind))
        return out

    schema = ", ".join(f"{c} {kinds[columns.index(c)].dataType.simpleString()}" for c in others)
    extra = "n_words long, intervals array<struct<start: int, stop: int>>, kept binary, _null boolean"
    asked = requests(dealt, sizes, keys_of)
    replies = answers(asked, sizes, "uint8", "uint8")
    done = resolved(dealt, replies, sizes, use, f"{schema}, {extra}" if schema else extra)
    kept = F.when(~F.col("_null"), F.col("kept").cast("string"))
    row = [kept.alias(text) if c == at else F.col(c).alias(n) for c, n in zip(columns, docs.columns)]
    return done.select(F.struct(*row).alias("row"), "n_words", "intervals", F.col("kept").cast("string").alias("kept"))


def _hashable(schema, columns: list[str], text: str) -> list[str]:
    """Columns that can take part in the hash that deals rows to chunks."""
    return [c for c, f in zip(columns, schema) if c != text and f.dataType.typeName() not in ("map", "variant")]


def n_removed(intervals_column: str = "intervals"):
    return F.aggregate(F.col(intervals_column), F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["start"]))
