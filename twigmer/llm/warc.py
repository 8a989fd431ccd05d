"""WARC archives of pages, and their capture index merged from locally sorted runs.

Archives are written by Spark's text writer, one record a row: a record ends in CR LF CR LF, of which
the last byte is the line separator, so that the files are plain WARC/1.1. They are read as whole
files (``binaryFile``), parsed by Content-Length, never by searching for separators.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import scratch, stored

CRLF = "\r\n"
#: Archives are read whole, one a row, and so have to stay small: in records, and in bytes of payload on average.
RECORDS_PER_FILE, BYTES_PER_FILE = 10_000, 128 << 20
#: Captures that one task merges, on average, and runs that one loser tree merges.
RANGE_ROWS, FAN_IN = 200_000, 256
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RUN_SCHEMA = (
    "page_id long, url string, urlkey string, captured long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, run string, offset long"
)
ORDER = ["urlkey", "captured", "page_id", "run", "offset"]


def base32_of_sha1(digest: Column) -> Column:
    """The bare upper-case base32 form of a hexadecimal SHA-1, by Spark functions."""
    parts = [F.lpad(F.upper(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path; scheme, ``www.``, port, fragment and case of the host go."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.", ""), r":\d+$", "")
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def utc(time: Column) -> Column:
    """A timestamp as WARC writes it, in UTC whatever the session's time zone."""
    days = F.floor(F.unix_seconds(time) / 86_400)
    second = F.unix_seconds(time) - days * 86_400
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"), F.lit("T"), two(second / 3600), F.lit(":"), two(second % 3600 / 60), F.lit(":"), two(second % 60), F.lit("Z"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages(page_id, url, html, captured)`` as gzipped WARC files.

    The payload is the html (null: empty). Of rows with equal payloads of at least ``min_bytes``,
    those with the smallest page_id are responses and the others revisit it, without a payload of
    their own; smaller payloads are all responses. Repeated rows with that page_id are all
    responses; rows without a page_id revisit unless no row of their payload has one. Null urls are
    written as empty. ``captured`` is a timestamp (null: the epoch).
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.coalesce("captured", F.timestamp_seconds(F.lit(0))).alias("captured"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest")  # from here on the digest is a column, not a hash to be computed again
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    kind = F.when(revisit, "revisit").otherwise("response")
    head = [
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Date: "), utc(F.col("captured"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_sha1(F.col("digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
    ]
    body = F.when(revisit, "").otherwise(F.col("payload"))
    record = F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *head), F.lit(CRLF + CRLF), body, F.lit(CRLF + "\r"))
    mean, most = pages.agg(F.avg(F.octet_length(payload)), F.max(F.octet_length(payload))).first()
    long = F.col("n") > BYTES_PER_FILE // 16

    def write(part: DataFrame, records: float) -> None:
        out = part.select(record.alias("value")).write.mode("append").option("compression", "gzip").option("lineSep", "\n")
        out.option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, int(records)))).text(path)

    some = (most or 0) > BYTES_PER_FILE // 16  # rows come dealt by digest, so that a file's mean is near that of all
    write(rows.where(~long) if some else rows, BYTES_PER_FILE / max(1, mean or 0))
    if some:
        write(rows.where(long), max(1, BYTES_PER_FILE // most))


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of one uncompressed WARC stream: offset, headers by lower-cased name, payload."""
    at = 0
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head, size = {}, len(line)
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        payload = stream.read(int(head["content-length"]))
        tail = stream.read(4)
        if tail != b"\r\n\r\n" or len(payload) != int(head["content-length"]):
            raise ValueError(f"broken WARC record at byte {at}")
        yield at, head, payload
        at += size + len(line) + len(payload) + len(tail)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives; digests and sizes come from the payload read (of revisits, from their headers).

    Each archive's captures are a run, which stands in one partition in the order of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime
        import gzip

        page = lambda s: None if s is None or s == "<urn:page:none>" else int(s[10:-1])
        names = ["page_id", "url", "captured", "record_type", "payload_bytes", "payload_digest", "refers_to", "run", "offset"]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for at, head, payload in records(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    n = int(head.get("x-payload-length", len(payload)))
                    if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                    date = datetime.datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC)
                    rows.append((page(head["warc-record-id"]), head["warc-target-uri"], int(date.timestamp()), head["warc-type"], n, digest, page(head.get("warc-refers-to")), file.rpartition("/")[2], at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    kinds = dict(x.split() for x in RUN_SCHEMA.split(", "))
    raw = files.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items() if k != "urlkey"))
    keyed = raw.withColumn("urlkey", url_key(F.col("url"))).select(*kinds)
    return keyed.sortWithinPartitions("run", *[F.asc_nulls_first(c) for c in ORDER])


class LoserTree:
    """A k-way merge: each inner node keeps the loser of its match, so that a step costs one path of log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at:
            if self.tree[at] < 0:  # the first to come waits for an opponent
                self.tree[at] = i
                return
            if not self._beats(i, self.tree[at]):
                i, self.tree[at] = self.tree[at], i
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            at = (i + self.k) // 2
            while at:
                if not self._beats(i, self.tree[at]):
                    i, self.tree[at] = self.tree[at], i
                at //= 2
            self.tree[0] = i


def merged_runs(runs: list[Iterator[tuple]], fan_in: int = 0) -> Iterator[tuple]:
    """Runs merged in passes of loser trees of ``fan_in`` runs each (FAN_IN by default), all of them streams."""
    fan_in = fan_in or FAN_IN
    while len(runs) > fan_in:
        runs = [iter(LoserTree(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    return iter(LoserTree(runs))


def merge_index(runs: DataFrame) -> DataFrame:
    """Merge sorted runs of captures (:data:`RUN_SCHEMA`, stored) into capture histories ordered across all tasks.

    Tasks take disjoint ranges of (urlkey, captured, page_id, ...) of some RANGE_ROWS captures, so that even one
    URL's captures spread over many tasks and a task's memory has a bound. In a task, rows come run by run, each
    run sorted; loser trees merge them, in passes where there are many runs. Adds ``range`` and ``slot``: the
    global order is by range, then slot. Null captures and ids sort first; repeated rows stay, in the order of
    their archive and offset; no runs give no rows.
    """
    nulls_first = [F.asc_nulls_first(c) for c in ORDER]
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *nulls_first).sortWithinPartitions("run", *nulls_first)
    names = dealt.columns
    at = [names.index(c) for c in ORDER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list[pa.RecordBatch]] = {}  # index rows of one range, as Arrow columns
        for batch in batches:
            own = batch.column("run").to_pylist()
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    held.setdefault(own[a], []).append(batch.slice(a, b - a))
        if not held:
            return

        def rows(k: int, parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            base = 0
            for p in parts:
                cols = [p.column(i).to_pylist() for i in at]
                for i, key in enumerate(zip(*cols, strict=True)):
                    yield tuple((v is not None, v) if v is not None else (False, 0) for v in key), k, base + i
                base += p.num_rows

        starts, base = [], 0
        for parts in held.values():
            starts.append(base)
            base += sum(p.num_rows for p in parts)
        order = [starts[k] + i for _, k, i in merged_runs([rows(k, parts) for k, parts in enumerate(held.values())])]
        whole = pa.Table.from_batches([p for parts in held.values() for p in parts]).take(pa.array(order, pa.int64()))
        n, part = whole.num_rows, TaskContext.get().partitionId()
        whole = whole.append_column("range", pa.array([part] * n, pa.int32())).append_column("slot", pa.array(range(n), pa.int64()))
        yield from whole.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, f"{RUN_SCHEMA}, range int, slot long")


def numbered(merged: DataFrame) -> DataFrame:
    """Add ``history_rank``, the place in the global order from 0: ranges follow each other, one total for each."""
    merged = stored(merged)
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").withColumn("history_rank", F.col("before") + F.col("slot")).drop("before")


def archive_report(pages: DataFrame) -> DataFrame:
    """The op1 contract: writes archives to shared scratch space, reads them back, writes their runs and merges them.

    Null html is an empty payload, rows of null page_id or equal ids each have their record, and an empty table gives no rows.
    Long pages get archives of their own; columns of other names are ignored.
    """
    path = scratch(pages.sparkSession)
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0)))
    write_archives(pages.select("page_id", "url", "html", captured.alias("captured")), path)
    runs = stored(read_archives(pages.sparkSession, path))
    merged = numbered(merge_index(runs))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "history_rank")


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex,
    regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as rest from pages),
k as (select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':[0-9]+$', '') as host, regexp_replace(rest, '^[^/?]*', '') as path from p),
d as (select page_id, strlen(payload) as payload_bytes, min(page_id) over (partition by hex) as first, 1700000000 + coalesce(page_id, 0) as captured,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as bigint), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1, 1)), '') as payload_digest,
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when path = '' then '/' else path end as urlkey from k)
select page_id, payload_bytes, payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
    case when first is null or page_id = first then null else first end as refers_to, urlkey, captured,
    row_number() over (order by urlkey, captured, page_id nulls first) - 1 as history_rank from d
"""
