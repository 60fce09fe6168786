"""Secret scans in column expressions: base patterns, and strings that look random.

Candidate strings are scored by two first-order Markov models over characters, one
of random strings and one of ordinary identifiers, by the logarithm of their
likelihood ratio. Both are trained from labelled samples: random ones are the
values the base patterns find and digests of row ids in the usual encodings;
ordinary ones are the corpus's own identifiers outside the base spans, every different
run of LEAST_WORD characters or more once, but for long runs that mix letters and
digits, which may be secrets themselves. A model is a table of the alphabet's pairs of
characters, so its size is fixed; an ordinary string leaves the pairs learnt with a
fixed probability, so that pairs not seen do not weigh more the larger the corpus is.

A candidate is what the base spans leave of a run of LEAST_LENGTH characters or more:
the spans are blanked out, and each run of that length in what is left is scored by itself.

Places come from cutting a text at a pattern: a match starts behind the pieces and
matches before it. Sums over what is before are built in blocks, strings are cut into
characters once, and pieces of a text are taken from chunks of it, so that the work on a
text grows with its length and its number of spans, not with their squares.

Defined results: a null text is an empty one; a text of any length is scanned whole, a run
of any length scored whole; repeated rows are scanned each; an
empty table gives an empty table; a corpus without labelled samples gives a ratio
of 0, which finds nothing; one of a few hundred words finds little beyond the base
patterns. Other columns take no part in the scan and pass
through the redaction unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from series_rank.session import materialize

# The base patterns, in the order of their kinds, and the least lengths of what they find.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

LEAST_LENGTH = 16
LEAST_WORD = 4
RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = f"{RUN}{{{LEAST_LENGTH},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: the start
PRIOR = 0.5
LEAVE = 0.01  # of an ordinary string, at each character
LEAST_RATIO = 12.0  # natural logarithm
SAMPLE_ROWS = 20_000  # bound of the rows whose digests are labelled random
MASK = "[SECRET]"

BLOCK = 64  # numbers summed up one by one; blocks of them are summed up as wholes
CHUNK = 4096  # characters

SPAN = "struct<start: int, kind: int, stop: int>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of a value that is computed once, also where the body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each number the join of those before it (0 for the first), in blocks; joins are sums or maxima."""

    def by_one(some: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(
            some,
            F.struct(F.lit(0).alias("at"), none.alias("done")),
            lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done")),
            lambda s: s["done"],
        )

    def by_block(all_: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK))
        return _bound(F.transform(at, lambda i: F.slice(all_, i + 1, F.lit(BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        leads = by_one(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)))
        return F.flatten(F.zip_with(blocks, leads, lambda b, lead: F.transform(by_one(b), lambda x: join(x, lead))))

    return _bound(numbers, lambda n: F.when(F.size(n) <= BLOCK, by_one(n)).otherwise(by_block(n)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, stop, value) of the matches, in code points; value is the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.transform(whole, F.length)
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(lengths)), lengths, lambda p, n: F.struct(p.alias("p"), n.alias("n"))
    )

    def placed(steps: Column) -> Column:
        spans = F.zip_with(
            _before(F.transform(steps, lambda s: s["p"] + s["n"]), _sum), steps,
            lambda at, s: F.struct((at + s["p"]).alias("start"), (at + s["p"] + s["n"]).alias("stop")),
        )
        return F.zip_with(
            spans, values, lambda s, v: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), v.alias("value"))
        )

    none = F.array().cast("array<struct<start: int, stop: int, value: string>>")
    return F.when(text.rlike(pattern), _bound(steps, placed)).otherwise(none)


def _without(text: Column, spans: Column, filled: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with *filled* in the place of each span; it gets start, stop and where the spans before have ended."""
    chunks = F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    )

    def piece(chunks: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        touched = F.array_join(F.slice(chunks, first + 1, F.floor((stop - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(stop > start, F.substr(touched, start - first * CHUNK + 1, stop - start)).otherwise("")

    def joined(chunks: Column) -> Column:
        ends = _before(F.transform(spans, lambda x: x["stop"]), _later)
        kept = F.zip_with(
            spans, ends, lambda x, end: F.concat(piece(chunks, end, x["start"]), filled(x["start"], x["stop"], end))
        )
        last = F.array_max(F.transform(spans, lambda x: x["stop"]))
        return F.concat(F.array_join(kept, ""), piece(chunks, last, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_bound(chunks, joined))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """*docs* with _base (spans), _values (what they hold) and _candidates."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumns({
        "_assign": F.filter(_matches(t, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE),
        "_access": _matches(t, ACCESS),
        "_hex": _matches(t, HEX),
    })
    base = F.concat(*(_spans(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:3])))
    values = F.concat(*(F.transform(F.col(f"_{k}"), lambda m: m["value"]) for k in KINDS[:3]))
    rows = rows.withColumns({"_base": F.array_sort(base), "_values": values})
    blank = _without(t, F.col("_base"), lambda a, b, end: F.repeat(F.lit(" "), F.greatest(b - F.greatest(a, end), F.lit(0))))
    rows = rows.withColumn("_blank", blank)
    return rows.withColumn("_candidates", _matches(F.col("_blank"), CANDIDATE)).drop("_assign", "_access", "_hex", "_blank")


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ordinary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(v): the different identifiers outside the base spans."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    free = F.regexp_replace(t, F.lit(ASSIGN.replace("]+)", f"]{{{ASSIGN_VALUE},}})")), F.lit(" "))
    words = F.regexp_extract_all(free, F.lit(f"{RUN}{{{LEAST_WORD},}}"), F.lit(0))
    v = F.col("v")
    long = F.length(v) >= LEAST_LENGTH
    return docs.select(F.explode(words).alias("v")).distinct().where(~(long & (_mixed(v) | v.rlike(ACCESS) | v.rlike(HEX))))


def pair_counts(
    scan: DataFrame, identifiers: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id"
) -> DataFrame:
    """(random, a, b, n): the pairs of characters in the labelled strings; a is empty at a start."""
    share = max(1, -(-scan.count() // sample_rows))
    digest = F.sha2(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), 256)
    drawn = F.pmod(F.xxhash64(doc_id), F.lit(share)) == 0
    made = F.when(drawn, F.array(digest, F.rtrim(F.base64(F.unhex(digest)), F.lit("="))))
    made = F.coalesce(made, F.array().cast("array<string>"))
    random = scan.select(F.explode(F.concat(F.filter("_values", _mixed), made)).alias("v"))
    rows = random.withColumn("random", F.lit(True)).unionByName(identifiers.withColumn("random", F.lit(False)))
    pair = _bound(
        F.split("v", ""),
        lambda v: F.zip_with(
            F.slice(F.concat(F.array(F.lit("")), v), 1, F.size(v)), v, lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        ),
    )
    pairs = rows.where(F.length("v") > 0).select("random", F.explode(pair).alias("p"))
    return pairs.groupBy("random", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(counts: DataFrame) -> list[float]:
    """By state * STATES + next state; at most 2 * STATES**2 rows are gathered."""
    place = {c: i + 1 for i, c in enumerate(ALPHABET)} | {"": 0}
    tables = {r: [[PRIOR] * STATES for _ in range(STATES)] for r in (True, False)}
    for row in counts.collect():
        if row["a"] in place and row["b"] in place:
            tables[row["random"]][place[row["a"]]][place[row["b"]]] += row["n"]
    leave = {True: 0.0, False: LEAVE}
    logs = {
        r: [[math.log((1 - leave[r]) * x / sum(line[1:]) + leave[r] / (STATES - 1)) for x in line] for line in t]
        for r, t in tables.items()
    }
    return [a - b for x, y in zip(logs[True], logs[False]) for a, b in zip(x, y)]


def ratio(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string being random."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    start = F.array(F.lit(0))

    def summed(states: Column) -> Column:
        steps = F.zip_with(F.slice(F.concat(start, states), 1, F.size(states)), states, lambda a, b: a * STATES + b + 1)
        return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.element_at(table, i))

    return _bound(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)), summed)


def all_spans(ratios: list[float], least: float = LEAST_RATIO) -> Column:
    """The base spans and those of random-looking candidates, by start, then kind."""
    odd = F.filter("_candidates", lambda c: ratio(c["value"], ratios) >= least)
    return F.array_sort(F.concat("_base", _spans(odd, len(KINDS) - 1)))


def written(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ","
    )


def learn(
    scan: DataFrame, identifiers: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id"
) -> list[float]:
    return log_ratios(pair_counts(scan, identifiers, sample_rows, doc_id))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind number, stop) of every row; texts are read twice."""
    scan = materialize(scanned(docs.select("doc_id", "text")).drop("text"), "scan")
    ratios = learn(scan, ordinary(docs))
    return scan.select("doc_id", F.col("_base").alias("base"), all_spans(ratios).alias("spans"))


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """*docs* with every secret in text replaced by *mask*, all other columns unchanged."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    scan = materialize(scanned(rows.drop("_row"), "_text").drop("_text"), "scan")
    spans = all_spans(learn(scan, ordinary(rows, "_text"), doc_id="_id"))
    out = scanned(rows, "_text").withColumn("_spans", spans)
    clean = _without(F.col("_text"), F.col("_spans"), lambda a, b, end: F.when(a >= end, F.lit(mask)).otherwise(""))
    return out.select(*(
        clean.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns
    ))
