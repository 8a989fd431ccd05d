"""SimHash fingerprints and their near neighbours by multi-index hashing.

A fingerprint of 64 bits is two segments of 32. Of two fingerprints that differ in 3 bits or fewer,
one segment differs in at most one. Each segment has a table of its values; a fingerprint looks up
its own value and the Hamming ball of radius one around it, and whatever it fetches is verified on
all 64 bits. Equal fingerprints are one node from the start, so that copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, quoted, stored, unused

BITS, SEGMENT_BITS, MOST_BITS_APART = 64, 32, 3
SHINGLE_WORDS = 3
SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text; see :func:`with_fingerprints`."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone change, ASCII blanks alone part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - k + 1)
    last = ends[min(k, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add ``out`` (long, the 64 bits as they are): per bit, whether over half the shingle hashes set it.

    Shingles are runs of 3 words after lower-casing A-Z, repeats included; texts of fewer words are
    one shingle; null, empty and blank texts have fingerprint zero. The text column is dropped.
    """
    rest = [c for c in docs.columns if c not in (text, out)]
    packed = docs.select(F.struct(*[quoted(c) for c in rest]).alias("rest"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(fps)], ["rest", "fp"])

    from pyspark.sql import types as T

    made = packed.mapInArrow(run, T.StructType([packed.schema["rest"], T.StructField("fp", T.LongType())]))
    return made.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("fp").alias(out))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs ``a < b`` of the distinct fingerprints ``fps(fp)`` at most 3 bits apart.

    A pair whose segments differ in one bit meets where the side that has the bit set looks up the
    value without it; so only such neighbours are looked up.
    """
    segments = F.array(*[F.struct(F.lit(i).alias("segment"), _segment(F.col("fp"), i).alias("value")) for i in range(BITS // SEGMENT_BITS)])
    tables = fps.select("fp", F.inline(segments))
    cleared = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda j: F.col("value").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))))
    ball = F.concat(F.array("value"), F.filter(cleared, lambda v: v != F.col("value")))
    probes = tables.select(F.col("fp").alias("other"), "segment", F.explode(ball).alias("value"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    pairs = probes.join(tables, ["segment", "value"]).where((F.col("fp") != F.col("other")) & (apart <= MOST_BITS_APART))
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and ``fp, component_fp, component_id``: each document with its class.

    Documents are linked if their fingerprints are at most 3 bits apart; ``component_id`` is the
    smallest doc_id of the component (null only where no document of it has one), ``component_fp``
    names the component by its smallest fingerprint. Repeated rows stay; an empty table has no rows.
    """
    rows = stored(with_fingerprints(docs, text))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_fingerprints(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("component_fp"))
    least = named.groupBy("component_fp").agg(F.min("first").alias("component_id"))
    named = stored(named.join(least, "component_fp").select("fp", "component_fp", "component_id"))
    return rows.join(named, "fp")


def simhash_report(docs: DataFrame) -> DataFrame:
    """The op6 contract, a row for each document, repeated rows included, see :func:`near_duplicates`.

    Null, empty and blank texts have fingerprint zero and are linked; texts of any length are hashed whole; of equal
    or null ids each row stays; an empty table has no rows; columns of other names are ignored.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text: str = "text") -> Column:
    """The 128-bit digest by which texts are told apart (null: empty)."""
    return F.unhex(F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary")))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document left of each component: that of the smallest doc_id (nulls last), then text digest.

    Components are those of :func:`near_duplicates`. All columns stay, whatever their names; nulls and empty texts
    are one component. Of rows that repeat in id and text, that of the least JSON form stays; an empty table stays empty.
    """
    found = near_duplicates(docs.select("doc_id", text_key(text).alias("text_key"), quoted(text).alias("text")), "text")
    return first_of_each(docs, found.withColumnRenamed("component_fp", "component"), text)


def first_of_each(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their component; ``found(doc_id, text_key, component)`` has a row for each of ``docs``."""
    own, key, n, one = unused(docs, "id", "key", "n", "one")
    keys = found.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")
    kept = keys.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias(own), F.col("k.text_key").alias(key), F.col("k.n").alias(n))
    kept = stored(kept)
    on = F.col("doc_id").eqNullSafe(F.col(own)) & (text_key(text) == F.col(key))
    once = docs.join(kept.where(F.col(n) == 1), on, "left_semi")
    again = docs.join(kept.where(F.col(n) > 1), on, "left_semi")
    row = F.struct(*[quoted(c) for c in docs.columns])
    again = again.groupBy("doc_id", text_key(text).alias(key)).agg(F.min_by(row, F.to_json(row)).alias(one))
    return once.unionByName(again.select(*[F.col(one).getField(c).alias(c) for c in docs.columns]))
