"""Toxicity by cumulative-link ordinal regression on sparse text features.

With one weight vector w and ordered thresholds t1 < t2 < ...,

    P(severity >= k | x) = sigmoid(w . x - tk)

and the expected severity is the sum of these over k. Features are hashed words
(ASCII lower case, without punctuation around them) with the value log(1 + times).

The labels say toxic or not. Severity 0 is not toxic; the toxic rows of the
training sample are graded 1 to GRADES by how many of their words are marked,
where a word is marked if it is found in far more toxic than other rows. The fit
uses at most SAMPLE_ROWS labelled rows of each label, those with the least hashes
of their ids, and of equal texts one. Its size is bounded, so it is made on the
driver from hashed features alone.

Defined results: a null or empty text has no features; a row labelled twice is
toxic if one label says so; null labels are left out; without rows of both labels
every severity is 0; repeated rows are scored each; an empty table gives an empty
table. Other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.llm.caches import family, only

BITS = 18
SAMPLE_ROWS = 4_000
GRADES = 3
MARKED = 3.0  # least log-odds of a marked word, and the toxic rows it has to be in
MARKED_ROWS = 10
LEAST_SCORE = 4.0  # standard errors by which a feature has to tell the labels apart
PENALTY = 0.1
STEPS = 800
RATE = 0.05
_EDGES = re.compile(rb"^[^A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff]+$")


class Features(dict):
    """Feature number by word, in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        bare = _EDGES.sub(b"", word)
        value = xxhash.xxh64_intdigest(bare) >> (64 - BITS) if bare else 0
        if len(self) < 150_000:
            self[word] = value
        return value


FEATURES = Features()
family("features", FEATURES.clear)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text."""
    words = text.lower().split()
    number, times = np.unique(np.fromiter(map(FEATURES.__getitem__, words), np.int64, len(words)), return_counts=True)
    return number, np.log1p(times)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(severity >= k) for k from 1 on, a column each."""
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _shares(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every feature the log-odds of toxic rows having it over the others', the difference of the
    shares of rows that have it in standard errors, and the toxic rows that have it."""
    size = 1 << BITS
    a, b = (np.bincount(np.concatenate([r[0] for r, x in zip(rows, toxic) if x == t]), minlength=size) for t in (1, 0))
    n1, n0 = (toxic == 1).sum(), (toxic == 0).sum()
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    p = (a + b + 0.5) / (n1 + n0 + 1)
    return odds, (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), a


def telling(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, least: float = LEAST_SCORE) -> list:
    """The rows with only the features whose shares in the two labels differ by *least* standard errors.

    Most words say nothing about the label; their small weights would add up in long texts."""
    keep = np.abs(_shares(rows, toxic)[1]) >= least
    return [(i[keep[i]], v[keep[i]]) for i, v in rows] if keep.any() else rows


def graded(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severities: 0 for rows that are not toxic, else by the marked words they have."""
    odds, _, times = _shares(rows, toxic)
    marked = (odds >= MARKED) & (times >= MARKED_ROWS)
    amount = np.array([v[marked[i]].sum() for i, v in rows])
    cuts = np.quantile(amount[toxic == 1], np.arange(1, grades) / grades)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, amount, "left"), 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], severity: np.ndarray, grades: int = GRADES) -> Ordinal:
    """Penalised likelihood by Adam over all rows; thresholds keep their order through their gaps."""
    used, column = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n, k = len(rows), np.arange(1, grades + 1)
    reached = severity[:, None] >= k
    share = np.clip(reached.mean(0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    gaps = np.maximum(np.diff(first), 1e-3)
    theta = np.concatenate([np.zeros(len(used)), first[:1], np.log(gaps)])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, free = theta[: len(used)], theta[len(used) :]
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(owner, w[column] * value, n)
        p = _sigmoid(score[:, None] - t)
        # A row's likelihood is P(>= y) - P(>= y + 1), with P(>= 0) = 1 and P(> grades) = 0.
        upper = np.column_stack([np.ones(n), p])[np.arange(n), severity]
        lower = np.column_stack([p, np.zeros(n)])[np.arange(n), severity]
        like = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like
        by_score = (du - dl) / n
        by_t = np.array([(-du * (severity == j) + dl * (severity == j - 1)).sum() / n for j in k])
        tail = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate([
            np.bincount(column, by_score[owner] * value, len(used)) - PENALTY * w / n,
            tail[:1], tail[1:] * np.exp(free[1:]),
        ])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = theta[: len(used)]
    free = theta[len(used) :]
    return Ordinal(weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[list, np.ndarray]:
    """Features and labels of the sample: at most *most* rows of each label."""

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("features")
        for batch in batches:
            each = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch]
            yield pa.StructArray.from_arrays([
                pa.array([i.astype("<i4").tobytes() for i, _ in each], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in each], pa.binary()),
            ], ["i", "v"])

    extract.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(known.toxic == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * most narrow rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["text"])
    made = F.arrow_udf(extract, "struct<i: binary, v: binary>")(F.col("text").cast("binary"))
    got = texts.select("toxic", "doc_id", made.alias("f")).orderBy("doc_id", "toxic").limit(2 * most).collect()
    rows = [(np.frombuffer(r["f"]["i"], "<i4"), np.frombuffer(r["f"]["v"], "<f4").astype(float)) for r in got]
    return rows, np.array([r["toxic"] for r in got], np.int64)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Ordinal | None:
    rows, toxic = training_rows(docs, labels, most)
    if len(set(toxic.tolist()) & {0, 1}) < 2 or not any(len(r[0]) for r in rows):
        return None
    return fit(telling(rows, toxic), graded(rows, toxic))


def scored(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row: the expected severity, the greatest grade that is
    likelier reached than not, and whether that is 1 or more."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("features")
        for batch in batches:
            out = np.zeros(len(batch))
            if model is None:
                p = np.zeros((len(batch), GRADES))
            else:
                for k, t in enumerate(batch):
                    i, v = features(t.as_buffer().to_pybytes() if t.is_valid else b"")
                    out[k] = model.weights[i] @ v
                p = model.at_least(out)
            grade = (p >= 0.5).sum(1)
            yield pa.StructArray.from_arrays(
                [pa.array(p.sum(1)), pa.array(grade, pa.int32()), pa.array(grade > 0)], ["severity", "grade", "toxic"]
            )

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(score, "struct<severity: double, grade: int, toxic: boolean>")(F.col("text").cast("binary"))
    return docs.select("doc_id", made.alias("s")).select("doc_id", "s.*")
