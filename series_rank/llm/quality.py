"""Quality rules with adaptive thresholds.

Every text is measured; the measures of each (language, source) go into
mergeable quantile sketches: histograms over whole numbers that keep eleven
significant bits (a relative error of at most 1/1024), so that merging is adding
counts, in any order, with the same result. Thresholds are outer fences: a
group's upper tenth, and FENCE times its distance from the middle beyond it (for word
lengths the lower tenth too). They have no fixed least; only the error of measure and
sketch is added, and a text fails a share by more than one event, since one symbol or
one repeated line or passage says nothing of its usual share. A group of fewer than MIN_DOCS texts takes the fences of its
language, and a small language those of all texts: the same sketches, merged.
The fences are joined back to the measured rows by language and source.

Defined results: a null text has no words and is rejected by the base rule; null
languages and sources are groups of their own; every row is judged by itself, so
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from series_rank.llm.caches import only
from series_rank.llm.words import covered, hash_words, window_hashes
from series_rank.session import materialize

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
REPEAT_WINDOW = 5
MIN_DOCS = 200
# Widths of the fences in distances from the middle to the outer tenth.
FENCE = 4.0
MEASURES = {
    "symbols": "1000 * n_symbols div nullif(n_words, 0)",
    "dup_lines": "1000 * n_dup_lines div nullif(n_lines, 0)",
    "repeats": "1000 * n_repeat_words div nullif(n_words, 0)",
    "upper": "1000 * n_upper div nullif(word_chars, 0)",
    "word_length": "100 * word_chars div nullif(n_words, 0)",
}
# What one event adds to a count: a passage said twice is two windows of words.
EVENTS = {
    "symbols": ("n_symbols", 1), "dup_lines": ("n_dup_lines", 1), "repeats": ("n_repeat_words", 2 * REPEAT_WINDOW),
    "upper": ("n_upper", 1),
}
TWO_SIDED = ("word_length",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text, as UTF-8."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    lines = dup = 0
    seen = set()
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    windows = window_hashes(hash_words(text), REPEAT_WINDOW) if n >= REPEAT_WINDOW else []
    if len(windows):
        _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[where] > 1)
        if len(starts):
            repeated = int(covered(starts, REPEAT_WINDOW, n).sum())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    upper = len(joined) - len(joined.translate(None, UPPER))
    return n, chars, symbols, dup, repeated, lines, upper


def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    only("words")
    for batch in batches:
        rows = [measure(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch]
        columns = list(zip(*rows)) or [[] for _ in COUNTS]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def measured(docs: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """*docs* with a struct of the counts."""
    counts = F.arrow_udf(_measures, "struct<" + ",".join(f"{c}: bigint" for c in COUNTS) + ">")
    # Marked so that a filter on the counts is not pushed below them, which would count twice.
    return docs.withColumn(into, counts.asNondeterministic()(F.col(text).cast("binary")))


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def _value(name: str, m: str) -> Column:
    return F.expr(re.sub("|".join(COUNTS), lambda c: f"{m}.{c[0]}", MEASURES[name]))


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source", m: str = "m") -> DataFrame:
    """(lang, source, name, bucket, n): one sketch a group and measure; to merge, add n."""
    words = rows.where(F.col(f"{m}.n_words") > 0)
    values = F.array(*(F.struct(F.lit(k).alias("name"), _value(k, m).alias("v")) for k in MEASURES))
    long = words.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(values).alias("e"))
    # Numbers of over eleven bits lose their lower ones.
    step = F.expr("shiftleft(1L, greatest(0, length(bin(e.v)) - 11))")
    bucket = F.floor(F.col("e.v") / step) * step
    return long.groupBy("lang", "source", F.col("e.name").alias("name"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def fences(table: DataFrame, min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """(lang, source, low, high): maps by measure, for every group in the sketches."""
    # Level 0: all; 1: the language; 2: the language and source.
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(i >= 1).alias("by_lang"), F.lit(i >= 2).alias("by_source"))
                       for i in range(3)))
    at = table.withColumn("at", F.explode(levels))
    key = [
        F.col("at.level").alias("level"),
        F.when(F.col("at.by_lang"), F.col("lang")).alias("lang"),
        F.when(F.col("at.by_source"), F.col("source")).alias("source"),
        F.col("name"),
    ]
    merged = at.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "lang", "source", "name")
    cumulated = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    tenth = {q: F.min(F.when(10 * F.col("upto") >= q * F.col("total"), F.col("bucket"))) for q in (1, 5, 9)}
    q = cumulated.groupBy("level", "lang", "source", "name").agg(
        tenth[1].alias("lower"), tenth[5].alias("middle"), tenth[9].alias("upper"), F.max("total").alias("total")
    )

    def room(a: str, b: str) -> Column:
        return F.greatest(fence * (F.col(b) - F.col(a)), 1 + F.col(b) / 1024)  # at least the errors

    low = F.when(F.col("name").isin(*TWO_SIDED), F.col("lower") - room("lower", "middle"))
    high = F.col("upper") + room("middle", "upper")
    bounds = q.select("level", "lang", "source", "name", "total", low.alias("low"), high.alias("high"))
    groups = table.select("lang", "source", "name").distinct()
    wide = groups
    for level in (2, 1, 0):
        b = bounds.where(F.col("level") == level).select(
            F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("name").alias("_n"),
            F.when((F.col("total") >= min_docs) | (F.lit(level) == 0), F.struct("low", "high")).alias(f"b{level}"),
        )
        on = F.col("name") == F.col("_n")
        on = on & F.col("lang").eqNullSafe(F.col("_l")) if level >= 1 else on
        on = on & F.col("source").eqNullSafe(F.col("_s")) if level >= 2 else on
        wide = wide.join(b, on, "left").drop("_l", "_s", "_n")
    best = F.coalesce("b2", "b1", "b0")
    return wide.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("name", best.getField("low")))).alias("low"),
        F.map_from_entries(F.collect_list(F.struct("name", best.getField("high")))).alias("high"),
    )


def judged(
    rows: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source", m: str = "m", into: str = "verdict"
) -> DataFrame:
    """*rows* with a struct: base_failed, failed (names of the measures beyond their fences) and kept."""
    b = bounds.select(F.struct("lang", "source", "low", "high").alias("_bounds"))
    on = F.col(lang).eqNullSafe(F.col("_bounds.lang")) & F.col(source).eqNullSafe(F.col("_bounds.source"))
    joined = rows.join(b, on, "left")
    outside = []
    for k in MEASURES:
        v = _value(k, m)
        out = v > F.element_at("_bounds.high", k)
        if k in EVENTS:
            count, event = EVENTS[k]
            out = out & (F.col(f"{m}.{count}") > event)
        if k in TWO_SIDED:
            out = out | (v < F.element_at("_bounds.low", k))
        outside.append(F.when(out, F.lit(k)))
    failed = F.filter(F.array(*outside), lambda x: x.isNotNull())
    verdict = F.struct(
        base_failed(m).alias("base_failed"), failed.alias("failed"), (~base_failed(m) & (F.size(failed) == 0)).alias("kept")
    )
    return joined.withColumn(into, verdict).drop("_bounds")


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """(doc_id, counts, base_failed, failed, kept) of every row; texts are read once."""
    slim = materialize(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    bounds = materialize(fences(materialize(sketches(slim), "sketches"), min_docs, fence), "fences")
    return judged(slim, bounds).select("doc_id", "m.*", "verdict.*")


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """The rows of *docs* that the rules keep, all columns unchanged.

    The texts are measured twice, once for the sketches and once where they are
    filtered, which costs less than moving or copying them.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    slim = measured(rows.drop("_row"), "_text", "_m")
    table = materialize(sketches(slim, "_lang", "_source", "_m"), "sketches")
    bounds = materialize(fences(table, min_docs, fence), "fences")
    out = judged(measured(rows, "_text", "_m"), bounds, "_lang", "_source", "_m", "_verdict")
    return out.where("_verdict.kept").select("_row.*")
