"""WARC archives and their capture index.

Writing: one record for each page. Of equal payloads the capture with the largest id is the
response; the others are revisits that refer to it. A record is one value of Spark's text
writer, whose separator is the record's closing CRLF CRLF, so files are plain (gzipped)
WARC and any store that Spark can write to will do.

Reading: archives are parsed by their lengths; each archive gives a run of index entries
sorted by URL key and timestamp. Runs are cut at shared splitters, and each range's pieces
are merged k ways by a loser tree; ranges end to end are the capture histories of all URLs.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

CRLF = "\r\n"
REVISIT_FROM = 1000  # bytes; smaller payloads are always stored
ARCHIVE_BYTES = 24 << 20  # of payload in an archive, about
RANGE_ROWS = 100_000  # index entries that one task merges, about
MOST_SAMPLES = 100_000  # keys that the driver gets to choose splitters from
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column) -> Column:
    """A name-based record id: the same page always has the same one."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("page:"), page.cast("string")).cast("binary")), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM) -> None:
    """Write a WARC record for each row. A null payload is empty; a row without id is a response that nothing refers to."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    large = rows.where((F.col("bytes") >= revisit_from) & F.col("id").isNotNull()).select("sha1", "id")
    target = large.groupBy("sha1").agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1").select("sha1", "target")
    moved = large.join(target, "sha1").where("id < target").select(F.col("id").alias("moved"), F.col("sha1").alias("of"), "target").distinct()
    rows = rows.join(moved, (F.col("id") == F.col("moved")) & (F.col("sha1") == F.col("of")), "left").drop("moved", "of")

    is_revisit = F.col("target").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    when = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << 30))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    value = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(is_revisit, F.lit(f"WARC-Type: revisit{CRLF}WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _line("WARC-Record-ID", F.coalesce(record_id(F.col("id")), F.concat(F.lit("<urn:sha1:"), F.col("sha1"), F.lit(">")))),
        _line("WARC-Date", when),
        _line("WARC-Target-URI", url),
        _line("X-Page-ID", F.col("id").cast("string")),
        _line("WARC-Refers-To", record_id(F.col("target"))),
        _line("X-Refers-To-Page-ID", F.col("target").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    sizes = pages.agg(F.count("*"), F.sum(F.octet_length(payload))).first()
    per_file = max(1, int(ARCHIVE_BYTES / max(1, (sizes[1] or 0) / max(1, sizes[0]))))
    rows.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def url_key(url: str) -> str:
    """The sort key of a URL: host names reversed, then the path; no scheme, www, default port or fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    path = (parts.path.rstrip("/") or "/") + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path.lower()}"


_ENTRY = "run long, seq long, sort_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run for each (number, content) archive: its entries sorted by URL key and timestamp."""
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            run, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
            entries = []
            for head, block in parse_archive(gunzip(data.to_pybytes())):
                http, _, body = block.partition(b"\r\n\r\n")
                kind, page, digest = head["warc-type"], head.get("x-page-id"), head["warc-payload-digest"].partition(":")[2]
                if kind == "response":
                    size, found = len(body), hashlib.sha1(body).hexdigest()
                    if found != digest:
                        raise ValueError(f"page {page}: payload digest is {found}, the record says {digest}")
                else:
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                stamp = re.sub(r"\D", "", head["warc-date"])
                page = None if page is None else int(page)
                refers = head.get("x-refers-to-page-id")
                key = f"{url_key(head.get('warc-target-uri', ''))} {stamp} {(page or 0) + (1 << 63):020d}"
                entries.append((key, page, size, digest, kind, None if refers is None else int(refers)))
            entries.sort(key=lambda x: x[0])
            if entries:
                columns = [[run] * len(entries), list(range(len(entries))), *map(list, zip(*entries))]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so the next
    winner costs one comparison a level. Equal keys come out in the order of the runs."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [-1] * self.k  # [0]: the winner
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        i, j = self.at[a], self.at[b]
        if i >= len(x) or j >= len(y):
            return i < len(x) or (j >= len(y) and a < b)
        return (x[i], a) < (y[j], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:  # while building: wait here for the other side
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it), in order of the keys."""
        left = sum(map(len, self.runs))
        while left:
            i = self.tree[0]
            yield i, self.at[i]
            self.at[i] += 1
            left -= 1
            self._play(i)


def _merge(table: pa.Table) -> pa.Table:
    """Of one range: its runs' pieces, merged."""
    table = table.sort_by([("run", "ascending"), ("seq", "ascending")]).combine_chunks()
    run, keys = table.column("run").to_pylist(), table.column("sort_key").to_pylist()
    starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
    pieces = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(run)])]
    order = [starts[i] + j for i, j in LoserTree(pieces)]
    out = table.take(pa.array(order, pa.int64())).drop_columns(["run", "seq"])
    return out.append_column("index_slot", pa.array(range(len(out)), pa.int64()))


def read_index(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Index entries of all archives below ``path``: ordered by (index_range, index_slot), hence by URL key, then timestamp."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.xxhash64("path").alias("run"), "content")
    runs = scratch.table(files.mapInArrow(_index, _ENTRY), "runs")
    n = runs.count()
    stride = max(8, math.ceil(n / MOST_SAMPLES))
    sample = sorted(r[0] for r in runs.where(F.pmod(F.xxhash64("run", "seq"), F.lit(stride)) == 0).select("sort_key").collect())
    ranges = max(1, math.ceil(n / RANGE_ROWS), min(len(sample), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = spark.sparkContext.broadcast([sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else [])

    def place(batches):
        for batch in batches:
            at = [bisect_right(cuts.value, k) for k in batch.column("sort_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["index_range", *batch.schema.names])

    placed = runs.mapInArrow(place, f"index_range int, {_ENTRY}")
    merged = f"index_range int, {', '.join(_ENTRY.split(', ')[2:])}, index_slot long"
    return placed.groupBy("index_range").applyInArrow(_merge, merged)


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    scratch.free()
    return read_index(spark, path, scratch)


def op10_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_capture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index with each capture's place: ranges in order, slots from 0 in each."""
    return _captured(spark, sf_dir).select("page_id", "index_range", "index_slot", "sort_key")


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < target THEN target END AS refers_to
FROM t
"""
