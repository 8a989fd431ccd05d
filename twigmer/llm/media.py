"""Media columns in a content-defined chunk store.

A payload is kept as a WAV file of 8-bit samples. A rolling gear hash cuts the file into chunks
where its contents say so, hence shared passages make shared chunks. Chunks that occur once stay in
the row of their file; those that occur again are stored once, by digest, and rows refer to them.
Files are put together from their ordered chunk lists and checked against their digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import scratch

PAD_TO = 192
LEAST, MASK_BITS, MOST = 1024, 12, 32_768
#: Which digests occur again is told to tasks as a bitmap of this many bits, whatever their number: a
#: unique chunk whose place is taken is stored by digest too, which costs a lookup and nothing else.
FILTER_BITS = 26
_GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)
_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")
MEDIA_SCHEMA = "doc_id long, n_bytes long, media_sha256 string, media_bytes long, chunks array<struct<digest:binary,size:int,bytes:binary>>"
_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // PAD_TO)) * PAD_TO - len(raw))


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    return _HEAD.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    head = _HEAD.unpack_from(media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[-1] != len(media) - _HEAD.size:
        raise ValueError("not a WAV file of 8-bit samples")
    return media[_HEAD.size :]


def gear_cuts(data: bytes) -> list[int]:
    """Ends of chunks: after bytes whose gear hash (of the last 32 bytes) has its high bits zero, within LEAST and MOST."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubling: each pass sums twice as many shifted bytes
        if len(h) > step:
            wide = h.copy()
            wide[step:] += h[:-step] << np.uint32(step)
            h = wide
    out, last = [], 0
    for end in (np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1).tolist():
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST:
            out.append(end)
            last = end
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def chunks_of(data: bytes) -> list[tuple[bytes, bytes]]:
    ends = gear_cuts(data)
    parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(hashlib.sha256(p).digest(), p) for p in parts]


def _place(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big") >> (32 - FILTER_BITS)


def _taken(filter_: bytes, digest: bytes) -> bool:
    p = _place(digest)
    return bool(filter_[p >> 3] >> (p & 7) & 1)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int | None, str | None]]:
    yield from zip(batch.column("doc_id").slice(at, 128).to_pylist(), batch.column("text").slice(at, 128).to_pylist(), strict=True)


def repeated_filter(docs: DataFrame) -> bytes:
    """The bitmap of chunk digests that occur twice or more: 2^26 bits, gathered as fixed pieces of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for at in range(0, batch.num_rows, 128):
                for _, text in _texts(batch, at):
                    counts.update(d for d, _ in chunks_of(wav(payload_of(text))))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    counted = docs.mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS)
    pieces = counted.select(F.shiftright(place, 15).alias("piece"), place.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = bytearray(1 << (FILTER_BITS - 3))
    for r in pieces.toLocalIterator():  # at most 2^11 pieces of 4 KB
        whole[r.piece * 4096 : (r.piece + 1) * 4096] = r.bits
    return bytes(whole)


def write_media(docs: DataFrame, path: str) -> None:
    """Store the payloads of ``docs(doc_id, text)``: files by document, and chunks that occur again by digest."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                for doc_id, text in _texts(batch, at):
                    media = wav(payload_of(text))
                    parts = [{"digest": d, "size": len(p), "bytes": None if _taken(shared.value, d) else p} for d, p in chunks_of(media)]
                    rows.append((doc_id, len((text or "").encode("utf-8", "surrogatepass")), hashlib.sha256(media).hexdigest(), len(media), parts))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "media_sha256", "media_bytes", "chunks"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, bytes] = {}
            for at in range(0, batch.num_rows, 128):
                for _, text in _texts(batch, at):
                    own.update((d, p) for d, p in chunks_of(wav(payload_of(text))) if _taken(shared.value, d))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], ["digest", "bytes"])

    docs.mapInArrow(files, MEDIA_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/files")
    docs.mapInArrow(again, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes")).write.option("compression", "zstd").parquet(f"{path}/chunks")


def describe(media: bytes) -> tuple[int, str, int, str]:
    """Payload size, its SHA-256, the CRC-32 of its last 16 bytes, and features of the samples."""
    samples = samples_of(media)
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    centred = x - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    feature = f"mean={int(x.sum()) / len(x):.6f};power={int((centred**2).sum()) / len(x):.6f};crossings={crossings};peak={int(x.max())}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), feature


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_bytes, media_sha256, media_bytes`` and features of every file, from the bytes as read back.

    Files that refer to no other chunk are put together where they lie. For the others each distinct
    file is put together once: its chunks are fetched by a join on digests and grouped by file.
    """
    rows = spark.read.schema(MEDIA_SCHEMA).parquet(f"{path}/files")
    refers = F.exists("chunks", lambda c: c["bytes"].isNull())
    keep = ["doc_id", "n_bytes", "media_sha256", "media_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "parts"]
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = []
                for sha, parts in zip(part.column("media_sha256").to_pylist(), part.column("parts").to_pylist(), strict=True):
                    media = b"".join(parts)
                    if hashlib.sha256(media).hexdigest() != sha:
                        raise ValueError(f"chunks don't make the file {sha}")
                    made.append(describe(media))
                cols = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *cols], [*names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    here = rows.where(~refers).select(*keep, F.transform("chunks", lambda c: c["bytes"]).alias("parts"))
    here = here.mapInArrow(run, f"doc_id long, n_bytes long, media_sha256 string, media_bytes long, {_FEATURES}")
    files = rows.where(refers).groupBy("media_sha256").agg(F.first("chunks").alias("chunks"))
    listed = files.select("media_sha256", F.posexplode("chunks").alias("at", "c")).select("media_sha256", "at", "c.digest", "c.bytes")
    chunks = spark.read.schema("digest binary, bytes binary").parquet(f"{path}/chunks")
    fetched = listed.where("bytes is null").drop("bytes").join(chunks, "digest").select("media_sha256", "at", "bytes")
    lists = fetched.unionByName(listed.where("bytes is not null").drop("digest")).groupBy("media_sha256").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("parts"))
    made = lists.select("media_sha256", F.transform("parts", lambda c: c["bytes"]).alias("parts")).mapInArrow(run, f"media_sha256 string, {_FEATURES}")
    return here.unionByName(rows.where(refers).select(*keep).join(made, "media_sha256"))


def media_report(docs: DataFrame) -> DataFrame:
    """The op2 contract; null texts count as empty, repeated rows each have their row, an empty table has none.

    Texts of any length are stored whole, as chunks of bounded size; columns of other names are ignored.
    """
    path = scratch(docs.sparkSession)
    write_media(docs, path)
    out = read_media(docs.sparkSession, path)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
