"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text gets a MinHash signature over its word n-grams, cut into bands whose
   number and rows are the cheapest that find a pair at the threshold with the
   target recall. Exact copies count as one representative with a weight.
2. Representatives meet by band hash. Band hashes are first counted alone, and only
   the entries of those that may repeat are moved. Buckets of the same members are
   one bucket.
3. Components of the bucket graph are candidates. A component that fits one task
   has all its pairs verified there, so every set moves once. A larger one, which
   chance links can make of any size, is verified bucket by bucket; a bucket too
   large for a task is cut into blocks, and pairs of blocks are tasks. A pair that
   shares several bands counts in the first of them. One text of each candidate meets
   its component before its n-grams are made, so sets move to their tasks only.
4. Pairs are counted where they are verified and never listed: a task gives each
   member its number of links and one edge to the least member it reaches. These
   edges, at most one a member and task, make the classes.

N-grams are held as 64-bit hashes. Texts of fewer words than n have one n-gram,
all their words. Similarities are compared as whole numbers, so the threshold
itself counts as similar.

Defined results: texts without a word (null, empty, blank) are similar to
nothing; repeated rows are copies of each other; the class id is the least doc_id
of the class (null only if all are); other columns take no part in the join. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.llm.caches import only
from series_rank.llm.components import components
from series_rank.llm.sieve import Sieve
from series_rank.llm.words import hash_texts, mix, window_hashes
from series_rank.session import materialize

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
TASK_MEMBERS = 512
TASK_NGRAMS = 2_000_000
SALTS = 16  # over which the copies of a text are dealt where texts are moved
COLUMNS = 2048  # of a membership matrix at a time


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest chance candidates, that reach the recall within *most* hashes."""
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 1e-12 else most + 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches the recall with so many hashes")


def ngrams(texts: list[bytes], n: int = NGRAM) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for words in hash_texts(texts):
        yield np.unique(window_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def _slices(batch: pa.Array, most: int = 256) -> Iterator[list[bytes]]:
    for at in range(0, len(batch), most):
        yield [t or b"" for t in batch.slice(at, most).to_pylist()]


def band_hashes(grams: np.ndarray, seeds: np.ndarray, bands: int) -> np.ndarray:
    """One number a band from the least permuted hash of each seed."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        np.minimum(least, (grams[at : at + 4096, None] * seeds).min(0), out=least)
    rows = len(seeds) // bands
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in mix(least).reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return out


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, text: str = "text") -> DataFrame:
    """(doc_id, key, n, bands): key stands for the exact text, n counts its n-grams."""
    seeds = _seeds(bands * rows)

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("words")
        for batch in batches:
            sizes, hashes = [], []
            for grams in (g for some in _slices(batch) for g in ngrams(some, n)):
                sizes.append(len(grams))
                hashes.append(band_hashes(grams, seeds, bands).view(np.int64) if len(grams) else [])
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["n", "bands"]
            )

    sign.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(sign, "struct<n: bigint, bands: array<bigint>>")
    raw = F.col(text).cast("binary")
    return docs.select("doc_id", _key(text).alias("key"), made(raw).alias("s")).select("doc_id", "key", "s.*")


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (key, id, weight, n, band, bucket) of buckets that may have two members, and the buckets
    (bucket, band, members, n) of two members or more, one for each set of members: the one of the first band."""
    met = reps.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("times"))
    again = Sieve.of(met.where("times > 1"), "bucket")
    entries = reps.select("key", "id", "weight", "n", F.posexplode("bands").alias("band", "bucket"))
    entries = materialize(entries.where(again.may_hold(F.col("bucket"))), "entries")
    sizes = entries.groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    ).where(F.col("members") > 1)
    one = sizes.groupBy("members", "x", "y").agg(F.min(F.struct("band", "bucket", "n")).alias("b"))
    return entries, one.select("b.bucket", "b.band", "members", "b.n")


class Pairs:
    """Which of some n-gram sets are similar."""

    def __init__(self, threshold: float) -> None:
        t = Fraction(str(threshold))
        # |A n B| / |A u B| >= p / q, with |A u B| = |A| + |B| - |A n B|
        self.p, self.q = t.numerator, t.denominator

    def similar(self, sets: list[np.ndarray]) -> np.ndarray:
        m = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        if m == 2:
            common = np.zeros((2, 2), np.int64)
            common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        else:
            owner = np.repeat(np.arange(m), sizes)
            _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = times[place] > 1
            number = np.cumsum(times > 1) - 1
            columns, owner = number[place[shared]], owner[shared]
            order = np.argsort(columns, kind="stable")
            columns, owner = columns[order], owner[order]
            total = np.zeros((m, m), np.float64)
            for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
                a, b = np.searchsorted(columns, [at, at + COLUMNS])
                has = np.zeros((m, min(COLUMNS, int(columns[b - 1]) - at + 1)), np.float32)
                has[owner[a:b], columns[a:b] - at] = 1
                total += has @ has.T
            common = total.astype(np.int64)
        out = common * (self.p + self.q) >= self.p * (sizes[:, None] + sizes)
        np.fill_diagonal(out, False)
        return out


def reached(similar: np.ndarray) -> np.ndarray:
    """The least member each member reaches, members being in the order of their keys."""
    label = np.arange(len(similar))
    while True:
        near = np.where(similar, label, len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_OUT = "key binary, root binary, links long"


def _members(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    order = np.argsort(np.array(table["key"].to_pylist(), object))
    table = table.take(pa.array(order))
    sets = [np.frombuffer(s, np.uint64) for s in table["grams"].to_pylist()]
    return table["key"].to_pylist(), table["weight"].to_numpy(), sets


def _verified(groups: DataFrame, threshold: float) -> DataFrame:
    """All pairs of each component, several components a task."""
    pairs = Pairs(threshold)

    def verify(table: pa.Table) -> pa.Table:
        roots = np.array(table["root"].to_pylist(), object)
        order = np.argsort(roots, kind="stable")
        edges = np.flatnonzero(np.append(True, roots[order][1:] != roots[order][:-1]))
        out: dict[str, list] = {"key": [], "root": [], "links": []}
        for own in np.split(order, edges[1:]):
            keys, weight, sets = _members(table.take(pa.array(own)))
            similar = pairs.similar(sets)
            out["key"] += keys
            out["root"] += [keys[i] for i in reached(similar)]
            out["links"] += (similar @ weight).tolist()
        return pa.table(out, pa.schema([("key", pa.binary()), ("root", pa.binary()), ("links", pa.int64())]))

    verify.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return groups.groupBy("cell").applyInArrow(verify, _OUT)


def _verified_blocks(entries: DataFrame, threshold: float) -> DataFrame:
    """The pairs of each bucket between (or within) its two blocks that share no earlier band."""
    pairs = Pairs(threshold)

    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["key"].to_pylist(), object))
        table = table.take(pa.array(order))
        keys, weight, sets = _members(table)
        block, band = table["block"].to_numpy(), table["band"][0].as_py()
        similar = pairs.similar(sets)
        if table["low"][0].as_py() != table["high"][0].as_py():
            similar &= block[:, None] != block
        bands = np.array(table["bands"].to_pylist(), np.int64)
        first = similar.copy()
        for k in range(band):
            first &= bands[:, k, None] != bands[:, k]
        out = {"key": keys, "root": [keys[i] for i in reached(similar)], "links": (first @ weight).tolist()}
        return pa.table(out, pa.schema([("key", pa.binary()), ("root", pa.binary()), ("links", pa.int64())]))

    verify.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return entries.groupBy("bucket", "low", "high").applyInArrow(verify, _OUT)


def _gram_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, root, weight, fits, grams) of the wanted representatives."""

    def gather(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("words")
        for batch in batches:
            yield pa.array([g.tobytes() for some in _slices(batch) for g in ngrams(some, n)], pa.binary())

    gather.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rows = docs.select("doc_id", "text", _key("text").alias("key"))
    rows = rows.where(Sieve.of(wanted, "key", "id").may_hold(F.col("key"), F.col("doc_id")))  # so that few texts are moved
    texts = rows.groupBy("key").agg(F.any_value("text").alias("text"))  # rows that repeat a whole representative
    own = texts.join(wanted.select("key", "root", "weight", "fits"), "key")
    return own.select("key", "root", "weight", "fits", F.arrow_udf(gather, "binary")(F.col("text").cast("binary")).alias("grams"))


def classes(
    docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL,
    task_members: int = TASK_MEMBERS, task_ngrams: int = TASK_NGRAMS,
) -> DataFrame:
    """(doc_id, key, root, class_id, n_links) of every row; root is null for texts without a word."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    reps = signed.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.any_value("n").alias("n"),
        F.any_value("bands").alias("bands"),
    )
    reps = materialize(reps, "representatives")
    entries, kept = buckets(reps)
    kept = materialize(kept, "buckets")
    members = materialize(entries.drop("band").join(kept.select("bucket", "band", "members", F.col("n").alias("total")), "bucket"), "members")
    star = members.groupBy("bucket").agg(F.min("key").alias("b"))
    near = components(members.join(star, "bucket").select(F.col("key").alias("a"), "b"))
    each = members.groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("id", "weight", "n")))
    wanted = near.select(F.col("node").alias("key"), "root").join(each, "key")
    sizes = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    fits = (F.col("size") <= task_members) & (F.col("total") <= task_ngrams)
    wanted = materialize(wanted.join(sizes.select("root", fits.alias("fits")), "root"), "candidates")
    sets = materialize(_gram_sets(docs, wanted, n), "ngrams")

    load = wanted.agg(F.sum("n").alias("n"), F.count_if(~F.col("fits")).alias("large")).first()
    cells = max(16, -(-(load["n"] or 0) // task_ngrams) * 4)
    small = sets.where("fits").drop("fits").withColumn("cell", F.pmod(F.xxhash64("root"), F.lit(cells)))
    found = _verified(small, threshold)
    if load["large"]:
        found = found.unionByName(_large(reps, members, sets.where("not fits"), threshold, task_members, task_ngrams))
    found = materialize(found, "links")

    labelled = reps.select("key", "id", "weight").join(found, "key", "left").select(
        "key", "id", F.coalesce("root", "key").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    heads = labelled.groupBy("root").agg(F.min("id").alias("class_id"))
    by_key = materialize(labelled.join(heads, "root").select("key", "root", "class_id", "n_links"), "classes")
    return signed.select("doc_id", "key").join(by_key, "key", "left").select(
        "doc_id", "key", "root",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _large(reps: DataFrame, members: DataFrame, sets: DataFrame, threshold: float, most: int, most_ngrams: int) -> DataFrame:
    """(key, root, links) of the representatives in components beyond one task, by their sets."""
    bands = reps.where(Sieve.of(sets, "key").may_hold(F.col("key"))).select("key", "bands")
    rows = members.select("bucket", "key", "band", "members", "total").join(sets.select("key", "weight", "grams"), "key").join(bands, "key")
    blocks = F.greatest(F.ceil(F.col("members") / most), F.ceil(F.col("total") / most_ngrams)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    out = materialize(_verified_blocks(rows.drop("other", "blocks", "members", "total"), threshold), "blocks")
    roots = components(out.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = out.groupBy("key").agg(F.sum("links").alias("links"))
    joined = links.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return joined.select("key", F.coalesce("root", "key").alias("root"), "links")


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of *docs*, all columns unchanged, with one of each class: the one with the class id
    (of several rows with that id, the one whose text has the least key). Texts without a word stay.

    Rows alone in their class pass without being moved; the others meet the heads of their classes."""
    rows = classes(docs, n, threshold, recall).where(F.col("root").isNotNull())
    sizes = rows.groupBy("root", "key", "doc_id", "class_id").agg(F.count(F.lit(1)).alias("copies"))
    heads = sizes.groupBy("root").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.struct("key", "doc_id", "copies"))).alias("h"),
        F.sum("copies").alias("size"),
    ).where("size > 1").select("root", "h.*")
    heads = materialize(heads, "heads")
    shared = Sieve.of(sizes.select("root", "key").join(heads.select("root"), "root", "left_semi"), "key")
    members = materialize(sizes.join(heads.select("root"), "root", "left_semi").select("key").distinct(), "grouped")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, _key("text").alias("key"), F.col("doc_id").alias("id"))
    keyed = keyed.withColumn("near", shared.may_hold(F.col("key")))
    alone = keyed.where(~F.col("near")).select("row.*")
    near = keyed.where("near").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    spread = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chance = near.join(spread, ["key", "salt"], "left_anti").select("row.*")
    h = heads.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "copies")
    held = near.join(h, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    once = held.where("copies = 1").select("row.*")
    again = held.where("copies > 1").groupBy("key", "id").agg(F.any_value("row").alias("row")).select("row.*")
    return alone.unionByName(chance).unionByName(once).unionByName(again)
