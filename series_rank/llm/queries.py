"""The numbered queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from series_rank.llm import (
    byte_bpe,
    jaccard,
    lexical,
    maxent,
    packing,
    quality,
    secrets,
    substrings,
    token_files,
    topk,
    toxicity,
    variants,
    warc,
)
from series_rank.llm.tables import documents, table

TOKENIZERS = "/opt/tokenizers"


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return secrets.found(documents(spark, sf_dir)).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the contract, and from the offsets the characters covered and the tokens that start inside one."""
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = byte_bpe.encoded(docs, path, _pattern(), with_offsets=True, with_decoded=True)
    shared = F.filter(F.zip_with("starts", F.concat(F.array(F.lit(0)), "ends"), lambda a, end: a < end), lambda x: x)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_covered"),
        F.size(shared).cast("long").alias("n_inside"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(documents(spark, sf_dir))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), f"{TOKENIZERS}/word_bpe_49k.json")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_words", substrings.n_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_best_fit": op6_best_fit,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_repeated_windows": op9_repeated_windows,
    "op10_top_k": op10_top_k,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc": op12_warc,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op9_repeated_windows": r"""
        WITH w AS (
            SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS words
            FROM documents),
        starts AS (
            SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
        again AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
        gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS places
            FROM starts SEMI JOIN again USING (win) GROUP BY doc_id),
        kept AS (
            SELECT doc_id, words, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
                CASE WHEN places IS NULL THEN words
                    ELSE [words[p] for p in range(1, len(words) + 1) if NOT list_contains(places, p)] END AS rest
            FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept""",
    "op10_top_k": r"""
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len([y for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # crc32 bit by bit: a byte joins before the first of its eight steps. Words share a key where one letter is left out.
    "op11_spelling_variants": r"""
        WITH RECURSIVE r AS (
            SELECT doc_id, w, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
            WHERE length(w) >= 6 GROUP BY ALL),
        b AS (
            SELECT w, n, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM r),
        h AS (
            SELECT w, n, xor(4294967295, list_reduce(
                flatten([[('0x' || substr(x, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0] for i in range(len(x) // 2)]),
                lambda c, y: xor(xor(c, y) >> 1, 3988292384 * (xor(c, y) & 1)), 4294967295)) AS h FROM b),
        v AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word
                FROM h)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        k AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS key
            FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
        near AS (
            SELECT x.word AS a, y.word AS b FROM k x JOIN k y USING (key, i) WHERE x.word <> y.word
            UNION SELECT k.word, v.word FROM k JOIN v ON k.key = v.word
            UNION SELECT v.word, k.word FROM k JOIN v ON k.key = v.word),
        best AS (
            SELECT a, b, m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS place
            FROM (SELECT a, b, v.n AS m FROM near JOIN v ON b = v.word)),
        f AS (
            SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN b END AS form,
                CASE WHEN m >= 5 * n THEN m END AS form_n
            FROM v LEFT JOIN best ON a = word AND place = 1),
        path AS (
            SELECT word, word AS at FROM f
            UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, path.at AS root, f.n, f.n_near, f.form_n
        FROM f JOIN path USING (word) JOIN f AS e ON e.word = path.at AND e.form IS NULL""",
    # base32: five hexadecimal digits are four of its digits.
    "op12_warc": r"""
        WITH x AS (
            SELECT page_id, encode(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
        y AS (SELECT page_id, last, octet_length(h)::BIGINT AS payload_bytes, sha1(h) AS s FROM x)
        SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1) for i in range(32)], '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM y""",
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, [x for x in regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') if x <> ''] AS words
            FROM documents),
        s AS (SELECT count(*) AS nd, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
        q AS (
            SELECT DISTINCT item_id, unnest([x for x in regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') if x <> '']) AS t
            FROM benchmark),
        tf AS (
            SELECT doc_id, r, n, t, count(*) AS tf FROM (SELECT doc_id, r, len(words) AS n, unnest(words) AS t FROM d)
            WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        w AS (
            SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
        c AS (
            SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
            FROM tf JOIN w USING (t) JOIN q USING (t), s GROUP BY ALL)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
            FROM c WHERE score > 0)
        WHERE rank <= 10""",
}
