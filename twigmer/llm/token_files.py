"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Spark's ORC writer and reader do the work: stripes are read in parallel, and a filter on ``doc_id``
is answered from file, stripe and row-group statistics and Bloom filters before any ids are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import scratch
from .bpe import _slices, byte_letters

FILE_SCHEMA = "doc_id long, shard int, slot long, start_in_shard long, ids array<int>"
STRIPE_BYTES = 32 << 20
ROWS_PER_INDEX = 1000
# Anything but characters on which the vocabulary's normalizer only lower-cases letter by letter (ASCII and Latin-1
# letters), without the control characters that str.split() takes for blanks and the vocabulary doesn't.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
# The split of the vocabulary file, for lower-case words of those characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_BLANKS = re.compile("[ \n\t\r]+")


class Remembered:
    """A bounded mapping of two generations: what was used since the last turn survives it."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes:
        """For keys that aren't in ``new``."""
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 32:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


class WordEncoder:
    """Encodes texts by the tokenizers library, once for each distinct word between blanks.

    For vocabularies that drop white space, lower-case, and split words into letters, digits and
    others. Texts of ASCII and Latin-1 letters go to the library's BPE model word part by word part;
    words of other texts, and texts with special tokens' spellings, take the whole library.
    """

    def __init__(self, path: str, kept: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = byte_letters()
        self.words = Remembered(self._word, kept)
        self.others = Remembered(self._other, kept // 4)

    def _part(self, p: str) -> bytes:
        written = p if p.isascii() and p.isalnum() else "".join([self.letters[b] for b in p.encode()])
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, w: str) -> bytes:
        """A lower-case word of plain characters; its parts are remembered as the words that they would be."""
        if w.isalpha():
            return self._part(w)
        parts = [w[:-1], w[-1]] if w[-1] in ".," and w[:-1].isalpha() else _PARTS.findall(w)
        if len(parts) == 1:
            return self._part(w)
        known, get = self.words.new, self.words.get
        return b"".join([known[p] if p in known else get(p) for p in parts])

    def _other(self, w: str) -> bytes:
        return np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or _OTHER.search(text):
            words, memory = [w for w in _BLANKS.split(text) if w], self.others
        else:
            words, memory = text.lower().split(), self.words
        out = []
        for at in range(0, len(words), 1 << 16):
            known, get = memory.new, memory.get
            out += [known[w] if w in known else get(w) for w in words[at : at + (1 << 16)]]
        return np.frombuffer(b"".join(out), dtype="<u4")


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text") -> None:
    """Encode every whole text and write its ids, ``end_id`` last, in ascending ``doc_id`` order.

    The table is ranged and sorted by ``doc_id`` (nulls first; rows that share one, by the hash of
    their text), so that files, stripes and row groups hold disjoint ranges of it. Each task is a
    shard: a row has its shard, its slot there and the number of ids before it in the shard. Null
    texts count as empty: they hold ``end_id`` alone. An empty table makes files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, slot, start = TaskContext.get().partitionId(), 0, 0
        enc, end = word_encoder(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                ids = [x for t in texts[a:b] for x in (enc.encode(t), end)]
                lengths = np.array([len(ids[i]) + 1 for i in range(0, len(ids), 2)], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                n = b - a
                columns = [
                    batch.column("doc_id").slice(a, n),
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(slot, slot + n, dtype=np.int64)),
                    pa.array(start + ends[:-1]),
                    pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(ids).astype(np.int32)),
                ]
                slot, start = slot + n, start + int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "slot", "start_in_shard", "ids"])

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The files' rows, with ``start``: the number of ids of all documents before it.

    ``doc_ids``: only these; the predicate reaches the ORC reader. Starts come from one total for
    each shard, of which there are as many as files:
    that is what the broadcast holds.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.max(F.col("start_in_shard") + F.size("ids")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", before.alias("before"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(*doc_ids))
    return rows.join(F.broadcast(totals), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "shard", "slot", "ids")


def token_report(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """The op3 contract: writes the files to shared scratch space and reports from what it reads back.

    Null and empty texts have the end id alone, repeated rows and ids each have their row, an empty table has none;
    texts of any length are one row of ids; columns of other names are ignored. See :func:`write_token_files`.
    """
    spark = docs.sparkSession
    path = scratch(spark)
    write_token_files(docs, path, vocabulary, end_id)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            values, ends = col.values.to_numpy().astype("<u4", copy=False), col.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            names = ["doc_id", "start", "shard", "slot"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], [*names, "n_tokens", "ids_crc32"])

    read = read_token_files(spark, path).mapInArrow(digest, "doc_id long, start long, shard int, slot long, n_tokens long, ids_crc32 long")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "slot")
