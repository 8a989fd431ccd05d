"""Fingerprints of whole texts by a randomised edit embedding, and near copies by bit-sampled bands.

A text is walked through from its first character: at step p, a random bit of p and the character, the same for
all texts, says whether the walk stays or moves on, and step p of the embedding is the character it stood on. Two
walks that an edit sets apart meet again soon, so that edit distance becomes Hamming distance between embeddings.

A fingerprint samples the steps of a grid, which gets coarser by powers of two with the text's length, so that 512
to 1 024 samples cover the whole embedding (all of it, for short texts); grids are nested, which makes texts of
different lengths comparable. Of each sampled character a random bit is kept. Fingerprints of near texts agree in
nearly all bits: bands of sampled bits find the candidates, and the complete fingerprints verify them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, quoted, stored
from .links import bucket_links, members_of

#: Samples of a fingerprint are at most twice as many.
SAMPLES = 512
#: Near copies have at least this likeness; bands of sampled bits find a pair at the bound with this probability.
SIMILAR, RECALL = 0.9, 0.95
#: A band has this many bits, and one more for each doubling of the number of texts.
BAND_BITS = 6
#: Classes of length by which bands are sampled; each is this much longer than the one before.
CLASS = 1 / SIMILAR
_PERIOD, _CHARS = 1 << 13, 1 << 16
_GRID = 0x2F6B5A39C71D84E3  # its lowest bits are where the nested grids begin


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random function of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stays() -> list[bytes]:
    """For each of 256 classes of characters and each step (modulo the period), how many steps a walk stands there."""
    moves = (_mixed(np.arange(256 * _PERIOD, dtype=np.uint64) + np.uint64(1 << 32)) >> np.uint64(63)).astype(bool).reshape(256, _PERIOD)
    out = np.zeros((256, _PERIOD), np.int64)
    ahead = np.argmax(moves, axis=1)  # from the period's end, on into its beginning
    for p in range(_PERIOD - 1, -1, -1):
        ahead = np.where(moves[:, p], 0, ahead + 1)
        out[:, p] = ahead + 1
    return [row.astype(np.uint8).tobytes() for row in out]


_tables: list[list[bytes]] = []


def _level(n_chars: int) -> int:
    """The logarithm of the grid's width for a text of this length; walks are about twice as long."""
    return max(0, (max(2 * n_chars, 1) - 1).bit_length() - (2 * SAMPLES - 1).bit_length())


class Walk:
    """A walk through a text, and the characters at the steps of a grid; the state after any piece can be walked on from."""

    def __init__(self, level: int):
        self.level, self.step, self.places, self.chars = level, 0, [], []

    def through(self, text: str) -> Walk:
        if not _tables:
            _tables.append(_stays())
        stays, mask, width = _tables[0], _PERIOD - 1, 1 << self.level
        begin = _GRID & (width - 1)
        for at in range(0, len(text), _CHARS):  # what is held for a very long text is one piece
            codes = np.frombuffer(text[at : at + _CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
            step, first, starts = self.step, self.step, []
            add = starts.append
            for c in ((codes ^ (codes >> np.uint32(8))) & np.uint32(255)).astype(np.uint8).tobytes():
                add(step)
                step += stays[c][step & mask]
            sampled = np.arange(first + (begin - first) % width, step, width)
            self.places.append(sampled)
            self.chars.append(codes[np.searchsorted(np.array(starts), sampled, "right") - 1])
            self.step = step
        return self

    def fork(self, level: int) -> Walk:
        """A walk that goes on from here, on a grid of this level or a coarser one."""
        out = Walk(self.level)
        out.step, out.places, out.chars = self.step, list(self.places), list(self.chars)
        return out.thinned(level)

    def thinned(self, level: int) -> Walk:
        if level > self.level:
            width = 1 << level
            keep = [p & (width - 1) == _GRID & (width - 1) for p in self.places]
            self.places = [p[k] for p, k in zip(self.places, keep, strict=True)]
            self.chars = [c[k] for c, k in zip(self.chars, keep, strict=True)]
            self.level = level
        return self

    def print(self) -> Fingerprint:
        places, chars = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.uint64) for x in (self.places, self.chars))
        bits = _mixed((places << np.uint64(24)) ^ (places >> np.uint64(40)) ^ chars) >> np.uint64(63)
        return Fingerprint(self.level, self.step, bits.astype(bool))


class Fingerprint:
    """``bits`` of the walk's steps at each ``2^level``, over ``steps`` in all."""

    def __init__(self, level: int, steps: int, bits: np.ndarray):
        self.level, self.steps, self.bits = level, steps, bits

    def at(self, level: int) -> np.ndarray:
        """The bits of a coarser grid."""
        places = np.arange(len(self.bits), dtype=np.int64) * (1 << self.level) + (_GRID & ((1 << self.level) - 1))
        return self.bits[places & ((1 << level) - 1) == _GRID & ((1 << level) - 1)]

    def likeness(self, other: Fingerprint) -> float:
        """The share of steps that the embeddings agree in, as estimated from the bits (of two unlike characters, half agree)."""
        level = max(self.level, other.level)
        a, b = self.at(level), other.at(level)
        most, least = max(len(a), len(b)), min(len(a), len(b))
        if not most:
            return float(self.steps == other.steps)
        apart = np.count_nonzero(a[:least] != b[:least]) + (most - least) / 2  # as if half of what one lacks agreed
        return max(0.0, 1 - 2 * apart / most)

    def text(self) -> str:
        """``level.steps.bits``, in hexadecimal digits."""
        return f"{self.level:x}.{self.steps:x}.{np.packbits(self.bits).tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        level, steps, digits = text.split(".")
        level, steps = int(level, 16), int(steps, 16)
        begin = _GRID & ((1 << level) - 1)
        n = max(0, -(-(steps - begin) // (1 << level)))
        return cls(level, steps, np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8), count=n).astype(bool))


def fingerprint(text: str | None) -> Fingerprint:
    """The fingerprint of a whole text; null is empty, and has no samples."""
    text = text or ""
    return Walk(_level(len(text))).through(text).print()


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``, the fingerprint as a string. Equal texts have equal ones, null and empty texts that of no steps; other columns pass through."""
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c != out]
    packed = docs.select(F.struct(*[quoted(c) for c in rest]).alias("rest"), F.coalesce(quoted(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py()).text() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(made, pa.string())], ["rest", "made"])

    rows = packed.mapInArrow(run, T.StructType([packed.schema["rest"], T.StructField("made", T.StringType())]))
    return rows.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("made").alias(out))


class Document:
    """A text, its fingerprint, and the walk through what its edited text keeps: all but the last half, rounded down."""

    def __init__(self, text: str):
        self.text, self.kept, level = text, len(text) - len(text) // 2, _level(len(text))
        self.begun = Walk(_level(self.kept)).through(text[: self.kept])  # an edited text may be shorter, hence have a finer grid
        self.print = self.begun.fork(level).through(text[self.kept :]).print()

    def columns(self, following: str, of_following: Fingerprint) -> tuple:
        """The columns of a document whose next one has this text and fingerprint."""
        new = self.text[: self.kept] + following[: len(self.text) - self.kept]
        other = self.begun.fork(_level(len(new))).through(new[self.kept :]).print()
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return len(self.text), sha, self.print.text(), other.text(), self.print.likeness(other), self.print.likeness(of_following)


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of ``docs(doc_id, text)``, each with the next document.

    Documents stand in descending order of doc_id (nulls last), those that share one in the order of a hash of
    their texts; after the last comes the first, so that a lone document is its own next. The table is ranged and
    sorted once; a partition's last document meets the first of the next partition afterwards.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "kind", "doc_id", *[c.split()[0] for c in _COLUMNS.split(", ")], "text"]
    types = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    done_names = ["doc_id", *types]

    def rows_of(rows: list[tuple], id_type: pa.DataType) -> list[pa.Array]:
        ids, values = [r[0] for r in rows], [r[1:] for r in rows]
        return [pa.array(ids, id_type), *(pa.array([v[k] for v in values], t) for k, t in enumerate(types.values()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, head = TaskContext.get().partitionId(), None, None

        def made(sort: int, rows: list[tuple], texts: list, id_type: pa.DataType) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([sort] * n, pa.int32()), *rows_of(rows, id_type), pa.array(texts, pa.string())], names)

        for batch in batches:
            id_type, out = batch.schema.field("doc_id").type, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                now = Document(text.as_py())
                if last is None:
                    head = (doc_id, now.text)
                else:
                    out.append((last[0], *last[1].columns(now.text, now.print)))
                last = (doc_id, now)
            if out:
                yield made(0, out, [None] * len(out), id_type)
        if last is not None:  # the first and the last of the partition, with their texts
            blank = (None,) * len(types)
            yield made(1, [(head[0], *blank)], [head[1]], id_type)
            yield made(2, [(last[0], *blank)], [last[1].text], id_type)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)
            out = [(doc_id, *Document(text).columns(following, fingerprint(following))) for doc_id, text, following in rows]
            yield pa.RecordBatch.from_arrays(rows_of(out, batch.schema.field("doc_id").type), done_names)

    tie = F.xxhash64("text")
    order = [F.desc_nulls_last("doc_id"), tie, F.md5("text")]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    both = stored(ordered.mapInArrow(run, f"part int, kind int, doc_id {kind}, {_COLUMNS}, text string"))
    # as many rows as partitions: which one comes after each
    parts = sorted(r.part for r in both.where("kind = 1").select("part").collect())
    follows = spark.createDataFrame([(p, n) for p, n in zip(parts, [*parts[1:], *parts[:1]], strict=True)], "part int, next int")
    heads = both.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    joins = both.where("kind = 2").select("part", "doc_id", "text").join(F.broadcast(follows), "part").join(heads, "next")
    closed = joins.select("doc_id", "text", "following").mapInArrow(ends, f"doc_id {kind}, {_COLUMNS}")
    return both.where("kind = 0").select(*done_names).unionByName(closed)


def bands_for(texts: int) -> tuple[int, int]:
    """Bits of a band, and bands, for this many distinct fingerprints."""
    bits = BAND_BITS + max(1, texts).bit_length()
    agree = (1 + SIMILAR) / 2  # a bit of two texts at the bound
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))


def bands_of(p: Fingerprint, bits: int, bands: int) -> np.ndarray:
    """The keys of a fingerprint's bands, in its class of length and in the next; two texts at the bound have a class in common.

    A class samples the steps up to those of its shortest walks, on a grid that all its walks have.
    """
    own, out = int(math.log(max(p.steps, 1)) / math.log(CLASS)), []
    for c in (own, own + 1):
        steps = math.ceil(CLASS**c)
        level = _level(math.ceil(0.75 * steps))  # as of longer texts than those of the class, so that none has a coarser grid
        n = max(1, steps >> level)
        seen = p.at(level)[:n]
        pick = _mixed(np.arange(bits * bands, dtype=np.uint64) + np.uint64(c << 32)) % np.uint64(n)
        chosen = np.r_[seen, np.zeros(n - len(seen), bool)][pick.astype(np.int64)].reshape(bands, bits)
        values = (chosen << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        out.append(_mixed(_mixed(values) + np.arange(bands, dtype=np.uint64) + np.uint64(c << 32)))
    return np.concatenate(out).view(np.int64)


def _payload(p: Fingerprint) -> np.ndarray:
    """A fingerprint as longs, for comparisons in cells."""
    packed = np.packbits(p.bits)
    return np.r_[p.level, p.steps, np.r_[packed, np.zeros(-len(packed) % 8, np.uint8)].view(np.int64)]


def _from_payload(x: np.ndarray) -> Fingerprint:
    level, steps = int(x[0]), int(x[1])
    n = max(0, -(-(steps - (_GRID & ((1 << level) - 1))) // (1 << level)))
    return Fingerprint(level, steps, np.unpackbits(np.ascontiguousarray(x[2:]).view(np.uint8), count=n).astype(bool))


def _near(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of two blocks of fingerprints are near."""
    a, b = ([_from_payload(x) for x in side] for side in (left, right))
    return np.array([[x.likeness(y) >= SIMILAR for y in b] for x in a], bool).reshape(len(a), len(b))


def components(prints: DataFrame) -> DataFrame:
    """``(fingerprint, component)`` of the distinct ``prints(fingerprint)``: near ones, by way of others too, share a number.

    Candidates share a band; each is verified by the likeness of the complete fingerprints, against the first of its
    bands, and where that fails against all others of it (:mod:`.links`).
    """
    named = stored(prints.withColumn("id", F.monotonically_increasing_id()))
    bits, bands = bands_for(named.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(bands_of(Fingerprint.parse(t), bits, bands)) for t in batch.column("fingerprint").to_pylist()]
            columns = np.repeat(batch.column("id").to_numpy(), [len(k) for k in made]), np.concatenate([np.zeros(0, np.int64), *made])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "key"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)
            yield batch.filter(pa.array([Fingerprint.parse(x).likeness(Fingerprint.parse(y)) >= SIMILAR for x, y in pairs], pa.bool_())).select(["a", "b"])

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_payload(Fingerprint.parse(t)) for t in batch.column("fingerprint").to_pylist()], pa.list_(pa.int64()))], ["id", "payload"])

    side = lambda c: named.select(F.col("id").alias(c), F.col("fingerprint").alias(f"of_{c}"))
    check = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(verified, "a long, b long")
    sets_of = lambda ids: named.join(ids, "id", "left_semi").mapInArrow(payloads, "id long, payload array<long>")
    buckets = stored(named.mapInArrow(keys, "id long, key long"))
    members = stored(members_of(buckets).select("id", "first").distinct())
    roots = connected_components(bucket_links(members, check, sets_of, _near))
    return named.join(roots, "id", "left").select("fingerprint", F.coalesce("root", "id").alias("component"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The op13 contract, and ``component_id``: the smallest doc_id among the near copies of a document, by way of others too.

    Null texts count as empty; an empty text has a fingerprint of no steps, like only other empty ones, and its
    edited text is empty. Texts of any length are walked through whole. Repeated rows stay, and ties of doc_id stand
    in the order of a hash of their texts, see :func:`with_next`; a null doc_id comes last and is in no
    ``component_id`` but where none of its copies has one. A lone document is its own next one; an empty table has
    no rows; other columns are ignored.
    """
    rows = with_next(docs.select("doc_id", "text"))
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    named = prints.join(components(prints.select("fingerprint")), "fingerprint")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(named.join(least, "component").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id")
