"""Spelling variants, WARC archives and lexical search against brute force, on odd and on given tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from series_rank.llm import lexical, variants, warc
from series_rank.llm.shipping import ship
from tests.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, key string, n long, id long, item string, score array<string>"
ROWS = [
    (1, None, "w", "k", 1, 5, "i", None),
    (2, "", None, None, None, None, None, ["x"]),
    (3, " \n\t !? ", "w", "k", 1, 1, "i", None),
    (None, "Window WINDOW window wandow ÄPFEL äpfel 日本語 token " * 4, "w", None, 1, 1, None, None),
    (None, "a null id too: Token window", "w", None, 1, 1, None, None),
    (4, "window " * 9000 + "windoww " * 700 + "x" * 70_000 + " ab" * 5000, None, "k", 1, 1, "i", None),
    (5, "window wimdow wimdow wimdow wimdow wimdow token×over÷token", None, "k", 1, 1, "i", None),
    (5, "window wimdow wimdow wimdow wimdow wimdow token×over÷token", None, "k", 1, 1, "i", None),
    (7, "token-token_token\x00token", None, "k", 1, 1, "i", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Window, token; wimdow", 1, None), (2, None, 2, None), (3, "?!", 3, None), (4, "äpfel ÄPFEL", 4, "x"),
        (4, "日本語 ab", 4, "x"), (None, "TOKEN×over÷token", 5, None), (6, "nothing of this", 6, None), (7, "window", 7, ""),
    ]
    return spark.createDataFrame(rows, "item_id long, text string, score long, doc_id string")


# ---- spelling variants ----------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows: list[tuple]) -> list[tuple]:
    counts = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    others = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in others.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(others[w]), n.get(form.get(w))) for w in n), key=repr)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_odd_rows(docs):
    got = rows_of(variants.grouped(docs), *COLUMNS)
    assert got == variants_of([r[:2] for r in ROWS])
    assert ("wimdow", "window", "window") in [r[:3] for r in got]
    assert {r[0] for r in got if "×" in r[0]} == {"token×over÷token"} or not [r for r in got if "×" in r[0]]


def test_variants_of_a_given_table(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(variants.grouped(table), *COLUMNS) == variants_of([(r.doc_id, r.text) for r in table.collect()])


def test_chains_of_forms_and_ties(spark, docs):
    words = {"chainaa": 5, "chainab": 25, "chainbb": 130, "dhainbb": 700, "otherx": 40, "othery": 40, "otherz": 6, "otherzz": 5}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    # An id whose checksums leave all of these words whole.
    doc_id = next(i for i in itertools.count() if all(zlib.crc32(f"{i}:{w}".encode()) % 199 for w in words))
    got = {r.word: r for r in variants.grouped(spark.createDataFrame([(doc_id, text)], "doc_id long, text string")).collect()}
    assert [got[w].root for w in ("chainaa", "chainab", "chainbb", "dhainbb")] == ["dhainbb"] * 4
    assert [got[w].form for w in ("chainaa", "chainab", "chainbb", "dhainbb")] == ["chainab", "chainbb", "dhainbb", None]
    assert (got["otherz"].form, got["otherz"].form_n, got["otherz"].n_near) == ("otherx", 40, 3)
    assert got["otherx"].form is None and got["otherzz"].form is None


@pytest.mark.parametrize("many", [1_000, 20])
def test_pairs_where_many_words_share_a_pivot(spark, docs, monkeypatch, many):
    monkeypatch.setattr(variants, "MANY_PAIRS", many)  # the second lets nearly every key grow
    rng = random.Random(5)
    made = {"qz" + "".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(900)}
    long = ["".join(rng.choice("ab") for _ in range(n)) for n in (63, 64, 65, 400)]
    made |= {w for x in long for w in (x, x[:20] + x[21:], x + "a", "c" + x[1:])}
    made |= {"a" * n for n in (*range(60, 70), 400, 401)}
    want = [(a, b) for a, b in itertools.combinations(sorted(made), 2) if abs(len(a) - len(b)) < 2 and near(a, b)]
    vocabulary = spark.createDataFrame([(w,) for w in made], "word string")
    assert sorted((r.a, r.b) for r in variants.near_pairs(vocabulary).collect()) == want


def test_pivots_are_the_cheapest_disjoint_bigrams():
    rng = random.Random(3)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        costs = [rng.randint(1, 30) for _ in places]
        cost = dict(zip(places, costs))
        a, b = variants.pivots(places, costs)
        assert a + 2 <= b and cost[a] + cost[b] == min(cost[x] + cost[y] for x in places for y in places if x + 2 <= y)


def test_checksums_are_linear():
    words = ["window", "äpfelmus", "x" * 127, "x" * 128, "x" * 3000]
    ids = [None, 0, -17, 1 << 62]
    crc, octets = (np.array([f(w.encode()) for w in words] * len(ids), np.int64) for f in (zlib.crc32, len))
    want = [zlib.crc32(f"{'' if i is None else i}:{w}".encode()) for i in ids for w in words]
    assert variants.checksums(ids, np.repeat(np.arange(len(ids)), len(words)), crc, octets).tolist() == want


# ---- archives -------------------------------------------------------------------------

PAGES_SCHEMA = "page_id long, url string, html string, key string, digest string, n long, latest long"
PAGES = [
    (1, "http://a/", "<p>one\r\n\r\ntwo</p>", "k", "d", 1, 2),
    (2, None, None, None, None, None, None),
    (3, "http://b c\r\nX: y\x7f/ü", "", "k", "d", 1, 2),
    (4, "http://a/", "<p>one\r\n\r\ntwo</p>", "k", "d", 1, 2),
    (4, "http://a/", "<p>one\r\n\r\ntwo</p>", "k", "d", 1, 2),
    (None, "http://c/", "<p>one\r\n\r\ntwo</p>", None, "d", 1, 2),
    (None, "http://d/", "only here é 日本語", None, "d", 1, 2),
    (9, "http://e/", "y" * 3_000_000, None, "d", 1, 2),
    *((20 + i, "http://copies/", "copied", None, None, i, i) for i in range(60)),
]


def records_of(pages: list[tuple]) -> list[tuple]:
    last = {}
    for page, html in pages:
        held = last.setdefault(html or "", page)
        if held is None or (page is not None and page > held):
            last[html or ""] = page
    out = []
    for page, html in pages:
        raw, other = (html or "").encode(), last[html or ""]
        kind = ("response", None) if page == other else ("revisit", other)
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind))
    return sorted(out, key=repr)


RECORD = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.fixture(scope="module")
def pages(spark):
    ship(spark)
    return spark.createDataFrame(PAGES, PAGES_SCHEMA)


@pytest.mark.parametrize("least", [10_000, 10])
def test_archives_of_odd_pages(spark, pages, monkeypatch, least):
    monkeypatch.setattr(warc, "HOT_LEAST", least)
    assert rows_of(warc.round_trip(pages), *RECORD) == records_of([(p[0], p[2]) for p in PAGES])


def test_archives_of_a_given_table(spark, pages):
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    twice = table.unionByName(table.withColumn("page_id", F.col("page_id") + 1_000_000))
    want = records_of([(r.page_id, r.html) for r in twice.collect()])
    assert rows_of(warc.round_trip(twice), *RECORD) == want
    assert sum(w[3] == "revisit" for w in want) >= table.count()


def test_index_selects_and_ranges_coalesce(spark, pages, tmp_path):
    index = warc.write(pages, f"file://{tmp_path}/archive")
    assert index.count() == len(PAGES) and index.where("length <= 0").isEmpty()
    members = index.groupBy("path").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("sum"))
    assert all(r.end == r.sum for r in members.collect())  # no gap between records
    assert warc.ranges(index).count() == members.count()  # small neighbours are one read
    chosen = warc.read(index.where("url = 'http://a/'"), payloads=True).collect()
    assert [(r.id, r.payload) for r in sorted(chosen, key=lambda r: r.id)] == [
        (1, None), (4, PAGES[0][2].encode()), (4, PAGES[0][2].encode()),
    ]
    urls = {r.url for r in index.select("url").collect()}
    assert None in urls and "http://b%20c%20X:%20y%20/ü" in urls


def test_every_record_is_a_gzip_member(pages, tmp_path):
    index = warc.write(pages, f"file://{tmp_path}/archive")
    for r in index.where("url = 'http://d/'").collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            fields, _, payload = warc.parse(zlib.decompress(f.read(r.length), 31))
        assert payload.decode() == PAGES[6][2] and fields["WARC-Target-URI"] == "http://d/" and "X-Page-ID" not in fields


def test_damaged_archive_is_noticed(spark, pages, tmp_path):
    index = warc.write(pages.where("page_id = 9"), f"file://{tmp_path}/archive")
    row = index.first()
    with open(row.path.removeprefix("file://"), "r+b") as f:
        raw = bytearray(zlib.decompress(f.read(), 31))
        raw[-100] ^= 1
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        made = squeeze.compress(bytes(raw)) + squeeze.flush()
        f.seek(0)
        f.write(made)
    with pytest.raises(Exception, match="does not hold its payload"):
        warc.read(index.withColumn("length", F.lit(len(made)).cast("long"))).collect()


# ---- lexical search ---------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def found_by(rows: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    counted = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in rows]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, query in wanted.items():
        scores = []
        for d, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                for t in query if t in c
            )
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


FOUND = ("item_id", "rank", "doc_id", "score")


def test_search_of_odd_rows(docs, items):
    want = found_by([r[:2] for r in ROWS], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(lexical.search(docs, items), *FOUND) == want
    assert {w[0] for w in want} == {1, 4, None, 7}
    assert rows_of(lexical.search(docs, items, top=1), *FOUND) == [w for w in want if w[1] == 1]


@pytest.mark.parametrize("terms", [1_000_000, 300])
def test_search_of_a_given_table(spark, docs, monkeypatch, terms):
    monkeypatch.setattr(lexical, "SHARD_TERMS", terms)  # the second divides the items
    table, asked = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    many = table.unionByName(table)  # every document twice: all scores tie
    want = found_by([(r.doc_id, r.text) for r in many.collect()], [(r.item_id, r.text) for r in asked.collect()])
    assert rows_of(lexical.search(many, asked), *FOUND) == want
    assert (len(list(lexical.shards(asked, "item_id", "text"))) > 1) == (terms == 300)


def test_best_of_blocks_with_ties():
    rng = np.random.default_rng(2)
    best, seen = lexical._Best(7, 4), []
    for _ in range(40):
        scores, docs = rng.integers(0, 9, (50, 7)), rng.integers(0, 60, 50)
        best.add(scores, docs, np.zeros(50, bool))
        best.prune()
        seen += [(i, -s, d) for row, d in zip(scores.tolist(), docs.tolist()) for i, s in enumerate(row) if s > 0]
    for i in range(7):
        want = sorted(x[1:] for x in seen if x[0] == i)[:4]
        at = best.item == i
        assert sorted(zip((-best.score[at]).tolist(), best.doc[at].tolist())) == want


def test_empty_tables(spark, docs, items, pages):
    none = spark.createDataFrame([], SCHEMA)
    assert variants.grouped(none).isEmpty() and warc.round_trip(pages.limit(0)).isEmpty()
    assert lexical.search(none, items).isEmpty() and lexical.search(docs, items.limit(0)).isEmpty()
    assert variants.grouped(docs.where("doc_id < 4")).isEmpty()  # rows without a word
