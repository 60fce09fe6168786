"""WARC archives of pages: written with their index, read back by coalesced byte ranges.

Every page becomes one record, compressed as a gzip member of its own, in files
of the shared folder. The tasks that write the files give the index: path, offset, length, URL,
payload digest and type of each record. The index is a table that Spark commits,
so a record exists when its index row does; files of lost or repeated attempts
have names of their own and are never referred to.

Reading starts from the index: the rows wanted are chosen there, sorted by file
and offset, and those that lie close together become one byte range, read at
once. Payload digests are computed again from the bytes read and must agree.

Of records with equal payloads (by SHA-256) that with the largest id is the
response, the others are revisits without a payload that name it. Which id is
the largest is found from digests alone; the payloads move once, dealt by digest.
Groups of more than max(HOT_LEAST, rows / HOT_MOST) equal pages number at most HOT_MOST: they are
broadcast, and their pages are spread by id.

Defined results: a null payload is empty; a null id is the smallest and is read
back as null; rows that repeat the largest id of their payload are all responses;
a null URL gives a record without one, white space and control characters in a
URL are written as %20; an empty table gives an empty table; other columns are
not read, whatever their names. Files are opened through pyarrow.fs, which takes local, hdfs, s3, gs
and abfs addresses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from series_rank.session import scratch_path

PARTITION_BYTES = 128 << 20  # of payload in one archive
HOT_LEAST, HOT_MOST = 10_000, 10_000
GAP_BYTES = 64 << 10  # read over rather than leave out
RANGE_BYTES = 8 << 20  # of one read
LEVEL = 1
INDEX = "path string, offset long, length long, url string, digest string, record_type string"
RECORDS = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

# The 32 digits of Spark's conv() and of base32, RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 of a binary or string column in upper-case base32: five hexadecimal digits are four of base32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def record_id(page: object, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, not yet compressed. The block is an HTTP message; that of a revisit has no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": record_id(refers_to, digest) if revisit else None,
        "X-Page-ID": page,
        "X-Refers-To-Page-ID": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/") or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _write_archives(rows: DataFrame, folder: str, date: str) -> DataFrame:
    """The index of the records that its tasks write below *folder*, a file a task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset = None, 0
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                index = []
                for page, url, payload, digest, n, latest, revisit in zip(*(c for c in batch.columns)):
                    kind = revisit.as_py()
                    raw = record(
                        page.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), n.as_py(), latest.as_py(), kind, date
                    )
                    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = squeeze.compress(raw) + squeeze.flush()
                    if out is None:
                        system, place = _file_system(folder)
                        system.create_dir(place, recursive=True)
                        out = system.open_output_stream(f"{place}/{name.rpartition('/')[2]}", compression=None)
                    out.write(member)
                    index.append((name, offset, len(member), url.as_py(), digest.as_py(), "revisit" if kind else "response"))
                    offset += len(member)
                if index:
                    columns = list(zip(*index))
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)],
                        ["path", "offset", "length", "url", "digest", "record_type"],
                    )
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(write, INDEX)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Write the pages as archives and their index below *folder*; returns the index as saved."""
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    keyed = pages.select(
        F.col(page_id).cast("long").alias("page"),
        F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]+", "%20").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"key": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload").cast("long")})

    # One row a payload that occurs more than once; only digests move for it.
    groups = keyed.groupBy("key").agg(F.max("page").alias("latest"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.schema(groups.schema).parquet(f"{folder}/groups")
    # With its scheme, which an address that Spark resolves by its own default may lack.
    base = groups.inputFiles()[0].rpartition("/groups/")[0]
    total = groups.agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("n")).alias("bytes")).first()
    limit = max(HOT_LEAST, (total["rows"] or 0) // HOT_MOST)
    parts = max(spark.sparkContext.defaultParallelism, -(-(total["bytes"] or 0) // PARTITION_BYTES))
    # At most rows / limit groups, so at most HOT_MOST.
    hot = groups.where(F.col("rows") > limit).select(
        "key", F.col("latest").alias("hot_latest"), F.lit(True).alias("hot"), (F.col("rows") / limit + 1).cast("int").alias("spread")
    )
    cold = groups.where((F.col("rows") > 1) & (F.col("rows") <= limit)).select("key", F.lit(0).alias("salt"), "latest", F.lit(True).alias("again"))

    placed = keyed.join(F.broadcast(hot), "key", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page"), F.col("spread")) + 1).otherwise(0).cast("int")
    older = F.col("hot") & ~F.col("page").eqNullSafe(F.col("hot_latest"))
    placed = placed.select(
        "page", "url", "key", "n", "hot_latest", "hot", salt.alias("salt"), sha1_base32(F.col("payload")).alias("digest"),
        # Known revisits leave their payload behind.
        F.when(~F.coalesce(older, F.lit(False)), F.col("payload")).alias("payload"),
    ).repartition(parts, "key", "salt")
    # The small side is hashed; rows with payloads are not sorted.
    joined = placed.join(cold.hint("shuffle_hash"), ["key", "salt"], "left")
    latest = F.when(F.col("hot"), F.col("hot_latest")).otherwise(F.col("latest"))
    revisit = F.coalesce(F.col("hot"), F.col("again"), F.lit(False)) & ~F.col("page").eqNullSafe(latest)
    rows = joined.select(
        "page", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "n",
        latest.alias("latest"), revisit.alias("revisit"),
    )
    index = _write_archives(rows, f"{base}/archives", date)
    index.write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(index: DataFrame) -> DataFrame:
    """(path, start, stop, records): byte ranges that cover the records of the index, sorted within a file.

    A range goes on over gaps of up to GAP_BYTES and ends with the record that
    reaches RANGE_BYTES; a file's index rows are bounded by its size.
    """
    placed = Window.partitionBy("path").orderBy("offset")
    ended = F.lag(F.col("offset") + F.col("length")).over(placed)
    fresh = ended.isNull() | (F.col("offset") - ended > GAP_BYTES)
    run = F.sum(F.when(fresh, 1).otherwise(0)).over(placed.rowsBetween(Window.unboundedPreceding, 0))
    marked = index.select("path", "offset", "length").withColumn("run", run)
    parts = marked.groupBy("path", "run", F.floor(F.col("offset") / RANGE_BYTES).alias("part")).agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),  # within RANGE_BYTES
    )
    return parts.select("path", "start", "stop", "records").sortWithinPartitions("path", "start")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _row(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, http, payload = parse(raw)
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    n = int(http["Content-Length"])
    if not revisit and (len(payload) != n or _digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
    page, other = (fields.get(f) for f in ("X-Page-ID", "X-Refers-To-Page-ID"))
    return page and int(page), n, digest, fields["WARC-Type"], other and int(other)


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index rows point to, read from the archives by coalesced ranges.

    With *payloads* a column ``payload`` holds the bytes, null for revisits.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = source = None
        for batch in batches:
            for at, start, stop, records in zip(*(batch.column(n) for n in ("path", "start", "stop", "records"))):
                if at.as_py() != path:
                    path = at.as_py()
                    system, place = _file_system(path)
                    source = system.open_input_file(place)
                first = start.as_py()
                held = source.read_at(stop.as_py() - first, first)
                rows, bodies = [], []
                for r in records.as_py():
                    member = held[r["offset"] - first : r["offset"] - first + r["length"]]
                    raw = zlib.decompress(member, 31)
                    rows.append(_row(raw))
                    if payloads:
                        bodies.append(None if rows[-1][3] == "revisit" else parse(raw)[2])
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if payloads:
                    columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "payload"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return ranges(index).mapInArrow(fetch, RECORDS + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages below *folder* (one of the shared scratch folders by default) and read every record back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder)).withColumnRenamed("id", "page_id")
