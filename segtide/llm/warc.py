"""WARC archives of pages, and capture histories in global order from merged local runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.llm.tables import ship, shuffle_partitions, write_shared

CAPTURED = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
RUN_ROWS = 50_000  # captures sorted in memory as one run
INDEX = ("url_key string, timestamp string, page_id bigint, url string, record_type string, refers_to bigint, "
         "payload_digest string, payload_bytes bigint, file string, place bigint")


def url_key(url: str) -> str:
    """Host labels from the right, then the path, in lower case, without scheme and ``www.``."""
    bare = re.sub(r"^[a-z][a-z0-9+.-]*://(www\.)?", "", url.lower())
    host = re.match(r"[^/:?#]*", bare)[0]
    rest = re.sub(r"^[^/?#]*", "", bare)
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def _digest(payload) -> F.Column:
    """SHA-1 as 32 base32 characters: the 160 bits in groups of five."""
    bits = F.sha1(payload)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = [F.lpad(F.conv(F.substring(bits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.lower(F.concat(*five)), "0123456789abcdefghijklmnopqrstuv", letters)


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add payload columns and what each page's record is: of equal payloads of at least ``min_bytes`` bytes the
    smallest ``page_id`` is the response and the others revisit it; smaller ones are all responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(payload).cast("bigint").alias("payload_bytes"),
                        _digest(payload).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first_page"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = write_shared(first, "repeated_payloads")  # Spark then knows its size: pages are shuffled only if it is large
    rows = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("page_id") != F.col("first_page")
    return (rows.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("first_page"))).drop("first_page"))


def _record(captured) -> F.Column:
    """The text of a WARC record up to the two line ends that close it. A revisit has the response's headers only:
    its payload's digest and length stand there."""
    line = "\r\n"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + line + "Content-Type: text/html; charset=utf-8" + line + "Content-Length: "),
                    F.col("payload_bytes"), F.lit(END))
    body = F.when(F.col("record_type") == "response", F.coalesce(F.col("html").cast("string"), F.lit(""))).otherwise("")
    revisit = F.when(F.col("record_type") == "revisit", F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + line
              + "WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">" + line))).otherwise("")
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = F.concat(F.lit("WARC/1.1" + line + "WARC-Type: "), F.col("record_type"), F.lit(line + "WARC-Record-ID: <urn:page:"),
                    F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">" + line + "WARC-Date: "), captured,
                    F.lit(line + "WARC-Target-URI: "), safe_url, F.lit(line + "WARC-Payload-Digest: sha1:"),
                    F.col("payload_digest"), F.lit(line), revisit,
                    F.lit("Content-Type: application/http; msgtype=response" + line + "Content-Length: "),
                    F.octet_length(http) + F.octet_length(body), F.lit(END))
    return F.concat(head, http, body)


def write_archives(pages: DataFrame, path: str, captured: str = CAPTURED, min_bytes: int = 0,
                   records_per_file: int = 10_000) -> None:
    """Write a WARC record for every row of ``pages`` (page_id, url, html) as gzip files below ``path``.

    A null page is an empty payload, a null url an empty target, a null id is written as none. ``timestamp``, where the pages have one, is the
    capture time; else ``captured`` is. Spark's text writer closes each record with the two line ends of the format.
    """
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "timestamp" in pages.columns else F.lit(captured)
    rows = classify(pages, min_bytes) if "timestamp" not in pages.columns else classify(pages, min_bytes).join(
        pages.select("page_id", "timestamp").dropDuplicates(["page_id"]), "page_id", "left")
    (rows.select(_record(F.coalesce(stamp, F.lit(captured))).alias("value")).write.option("lineSep", END)
     .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and place of each record of an unpacked archive, by content length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4:end + 4 + size], at
        at = end + 4 + size + 4


def _order(row: tuple) -> tuple:
    """Key of a capture: url key, timestamp, page (none first), then where it stands."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, so the next row costs one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (_order(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        one, other = self.heads[a], self.heads[b]
        return one is not None and (other is None or one[:2] < other[:2])

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # the first to arrive waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            top = self.losers[0]
            yield self.heads[top][2]
            self.heads[top] = self._next(top)
            self._replay(top)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``, read back from their records: one sorted run after another."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = []

        def sorted_run() -> pa.RecordBatch:
            run.sort(key=_order)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run), _TYPES)], names=_NAMES)

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for head, block, at in _parse(gzip.decompress(content.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    page, refers = head["warc-record-id"][len("<urn:page:"):-1], head.get("warc-refers-to")
                    if refers:  # the payload stands in the response
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        size = int(re.search(rb"(?i)content-length: *([0-9]+)", http)[1])
                    else:
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    run.append((url_key(head["warc-target-uri"]), head["warc-date"],
                                None if page == "none" else int(page), head["warc-target-uri"], head["warc-type"],
                                int(refers[len("<urn:page:"):-1]) if refers else None, digest, size, file, at))
                    if len(run) >= RUN_ROWS:
                        yield sorted_run()
                        run = []
        if run:
            yield sorted_run()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(work, INDEX)


_NAMES = [c.split(" ")[0] for c in INDEX.split(", ")]
_TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in INDEX.split(", ")]


def capture_history(captures: DataFrame) -> DataFrame:
    """All captures in global order of (url key, timestamp, page), in ranges: sorted runs meet in a loser tree.

    Spark samples the ranges' bounds; the order ends with the record's own place, so one crowded url key is cut
    like any other. Inside a range the rows of each shuffled batch form a run, and the runs are merged.
    Returns the captures with ``range_no`` and ``rank`` in the range.
    """
    ranges = captures.select(*_NAMES).repartitionByRange(shuffle_partitions(captures), "url_key", "timestamp", "page_id", "file", "place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        runs = []
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=_order)
            runs.append(iter(rows))
        part, out, rank = TaskContext.get().partitionId(), [], 0
        for row in LoserTree(runs):
            out.append((*row, part, rank))
            rank += 1
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names, types = [*_NAMES, "range_no", "rank"], [*_TYPES, pa.int32(), pa.int64()]
    return ranges.mapInArrow(merge, INDEX + ", range_no int, rank bigint")


def archive_pages(pages: DataFrame, path: str, captured: str = CAPTURED, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read them back, and return their capture history.

    One row for each input row: repeated pages are records of their own (of equal payloads and equal ids all are
    responses), null pages are empty payloads, a null id stays null and is a response unless a page with an id has
    its payload; other columns are ignored, an empty table gives no row.
    """
    ship(pages)
    write_archives(pages.select([c for c in pages.columns if c in ("page_id", "url", "html", "timestamp")]), path, captured,
                   min_bytes)
    return capture_history(write_shared(read_archives(pages.sparkSession, path), "captures"))
