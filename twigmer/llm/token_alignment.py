"""Alignment of two tokenizers over the same bytes, and the statistics of linked ids over a corpus.

Both encode each text; a dictionary for each leads from the byte places where tokens end to token numbers. The
places that both dictionaries have, in order, cut the two id lists into groups; links (pairs of tokens whose
bytes overlap) are expanded group by group.

Neither tokenizer has a token that goes over from a visible character to a blank after it, nor do such tokens depend on
each other (this is checked of the vocabularies); so texts are cut there, and what a part becomes is remembered.

How many documents hold a pair of ids linked is counted in two steps. Documents are taken in blocks of bounded
size; a block names each of its pairs once, with the number of its documents that hold it, and a document refers
to the block's pairs by number. Only the blocks' pairs are shuffled by pair, so that a pair which every document
has makes one row a block. Their counts go back to the block, where its documents are summed up.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._shared import quoted, stored

#: Distinct pairs of documents, summed over a block; a document of more is a block of its own.
BLOCK_PAIRS = 1 << 21
#: Characters of a batch of texts that are encoded and passed on at once.
SLICE_CHARS = 1 << 18
#: Parts of texts that a worker remembers, and their tokens; beyond that, it keeps the half that was met most.
PARTS, PART_TOKENS = 100_000, 2_000_000
_PARTS = re.compile(r"(?s)(?<=\S)(?= .)")  # a last blank alone would be lost, as the tokenizers add none to an empty text


class PieceEncoder:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        one = lambda i, p: bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
        self.bytes = [one(i, self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())]
        self.sizes = np.array([len(x) for x in self.bytes])

    def by_parts(self) -> bool:
        """Whether pieces have blanks only at their beginning and texts aren't normalised, so that words are encoded apart."""
        proto = self.library.serialized_model_proto()
        return b"\x0a\x08identity\x12\x00" in proto and not any("▁" in self.library.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes)))


class Remembered:
    """The tokens and groups of parts of texts: of each side one row of ids, and where those of a part begin."""

    def __init__(self, a: bpe.ByteEncoder, b: PieceEncoder):
        self.a, self.b, self.cut = a, b, b.by_parts()
        self.decimal = list(map(str, range(max(len(a.bytes), len(b.bytes)))))
        self.barred = [d + "|" for d in self.decimal]
        self.forget()

    def forget(self, kept: int = 0) -> None:
        """Keep this many parts, those met most."""
        if not kept:
            none = np.zeros(0, np.int32)
            self.known: dict[str, int] = {}
            # ids of A and B, of each group how many ids of its part come before its end, and linked pairs; then how many parts have of each
            self.rows, self.sizes = [none, none, none, none, none.astype(np.int64)], [none.astype(np.int64)] * 5
            self.same, self.met, self.written = none.astype(bool), none.astype(np.int64), []
            return
        best = np.sort(np.argsort(-self.met, kind="stable")[:kept])
        names = list(self.known)  # in the order of their numbers
        self.known = {names[i]: k for k, i in enumerate(best.tolist())}
        self.rows = [self.of(side, best) for side in range(5)]
        self.sizes = [n[best] for n in self.sizes]
        self.written = list(map(self.written.__getitem__, best.tolist()))
        self.same, self.met = self.same[best], self.met[best] // 2

    def of(self, side: int, parts: np.ndarray) -> np.ndarray:
        """One side's row for these parts, one after another."""
        n = self.sizes[side][parts]
        starts = (np.cumsum(self.sizes[side]) - self.sizes[side])[parts]
        return self.rows[side][np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def learn(self, parts: list[str]) -> None:
        """Encode parts under both; one that B doesn't keep has no tokens."""
        right = self.b.library.encode(parts, num_threads=1)
        left = [self.a.fast.encode_ordinary(" " + p) for p in parts]
        piece = self.b.bytes.__getitem__
        same = np.array([b"".join(map(piece, y)) == b" " + p.encode() for p, y in zip(parts, right, strict=True)], bool)
        sides = [[x if ok else [] for x, ok in zip(side, same, strict=True)] for side in (left, right)]
        ids = [np.fromiter(chain.from_iterable(side), np.int32) for side in sides]
        sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in sides]
        # one after another, all parts are one text, in which each part's end is common
        places = [np.cumsum(enc.sizes[x]) for enc, x in zip((self.a, self.b), ids, strict=True)]
        ends = group_ends(*places)
        bounds = [np.cumsum(n) for n in sizes]
        upto = np.searchsorted(ends[0], bounds[0], side="right")
        groups = np.diff(upto, prepend=0)
        left, right = expand_links(*places, *ends)
        owner = np.searchsorted(bounds[0], left, side="right")
        pairs = (ids[0][left].astype(np.int64) << 32 | ids[1][right])[np.argsort(owner, kind="stable")]
        lines = self.lines(*ids, *ends)
        self.written += [";".join(lines[i:j]) for i, j in pairwise([0, *upto.tolist()])]
        ends = [(e - np.repeat(bound - n, groups)).astype(np.int32) for e, bound, n in zip(ends, bounds, sizes, strict=True)]
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.rows = [np.concatenate(x) for x in zip(self.rows, [*ids, *ends, pairs], strict=True)]
        self.sizes = [np.concatenate(x) for x in zip(self.sizes, [*sizes, groups, groups, np.bincount(owner, minlength=len(parts))], strict=True)]
        self.same, self.met = np.r_[self.same, same], np.r_[self.met, np.zeros(len(parts), np.int64)]

    def lines(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[str]:
        """Each group as its decimal ids."""
        p, r = np.r_[0, i[:-1]][: len(i)], np.r_[0, j[:-1]][: len(j)]
        out = list(map(add, map(self.barred.__getitem__, x[p].tolist()), map(self.decimal.__getitem__, y[r].tolist())))
        joined = lambda ids: ",".join(map(self.decimal.__getitem__, ids.tolist()))
        for g in np.nonzero((i - p > 1) | (j - r > 1))[0].tolist():
            out[g] = joined(x[p[g] : i[g]]) + "|" + joined(y[r[g] : j[g]])
        return out

    def place(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The parts of texts, and the number of the text that each belongs to; texts that B doesn't keep have none."""
        cut = [(_PARTS.split(" " + t) if self.cut else [" " + t]) if t else [] for t in texts]
        parts = [p[1:] for own in cut for p in own]
        if len(self.known) > PARTS:
            self.forget(PARTS // 2)
        if len(self.rows[0]) > PART_TOKENS:
            self.forget()
        if fresh := list(set(parts).difference(self.known)):
            self.learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        self.met += np.bincount(at, minlength=len(self.met))
        owner = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        lost = np.bincount(owner, ~self.same[at], len(texts)) > 0
        return at[~lost[owner]], owner[~lost[owner]]

    def align(self, texts: list[str | None]) -> list[pa.ListArray]:
        """Ids of A and B and ends of groups on either side, a list for each text."""
        at, owner = self.place(texts)
        before, out = [], []  # ids of its text that come before a part
        for side, sizes in enumerate(self.sizes[:4]):
            n, values = sizes[at], self.of(side, at)
            ends = np.r_[0, np.cumsum(np.bincount(owner, n, len(texts)).astype(np.int64))]
            if side < 2:
                before.append(np.cumsum(n) - n - ends[owner])
            else:
                values = values + np.repeat(before[side - 2], n).astype(np.int32)
            out.append(pa.ListArray.from_arrays(ends.astype(np.int32), values.astype(np.int32)))
        return out

    def counted(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and B, groups, links, the digest of its groups, and its distinct pairs with their times."""
        at, owner = self.place(texts)
        n_a, n_b, groups, _, links = (np.bincount(owner, n[at], len(texts)).astype(np.int64).tolist() for n in self.sizes)
        pairs, of = self.of(4, at), np.repeat(owner, self.sizes[4][at])
        order = np.lexsort((pairs, of))
        pairs, of = pairs[order], of[order]
        heads = np.nonzero(np.r_[True, (np.diff(pairs) != 0) | (np.diff(of) != 0)][: len(pairs)])[0]
        times, pairs = np.diff(np.r_[heads, len(pairs)]), pairs[heads]
        bounds = np.searchsorted(of[heads], np.arange(len(texts) + 1)).tolist()
        written = list(map(self.written.__getitem__, at.tolist()))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        for k in range(len(texts)):
            sha = hashlib.sha256(";".join(written[ends[k] : ends[k + 1]]).encode()).hexdigest() if n_a[k] else ""
            own = slice(bounds[k], bounds[k + 1])
            yield n_a[k], n_b[k], groups[k], links[k], sha, pairs[own], times[own]


_remembered: dict[tuple[str, str], Remembered] = {}


def remembered(vocabulary: str, model: str) -> Remembered:
    """One memory for each pair of tokenizers and worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (vocabulary, model) not in _remembered:
        _remembered[vocabulary, model] = Remembered(bpe.encoder(vocabulary), PieceEncoder(model))
    return _remembered[vocabulary, model]


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side come before the end of each group, given the byte places where tokens end."""
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = list(filter(index_b.__contains__, index_a))  # ascending, as the keys of a dictionary keep the order they came in
    return tuple(np.fromiter(map(index.__getitem__, common), np.int32, len(common)) for index in (index_a, index_b))


def expand_links(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token numbers of all overlapping pairs, group by group (in no further order)."""
    first_a, first_b = np.r_[0, cuts_a[:-1]][: len(cuts_a)], np.r_[0, cuts_b[:-1]][: len(cuts_b)]
    m, n = cuts_a - first_a, cuts_b - first_b
    plain = np.nonzero((m == 1) | (n == 1))[0]  # one token of a side overlaps all of the other
    counts = np.maximum(m[plain], n[plain])
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(first_a[plain], counts) + np.where(np.repeat(m[plain] > 1, counts), at, 0)
    right = np.repeat(first_b[plain], counts) + np.where(np.repeat(n[plain] > 1, counts), at, 0)
    more_a, more_b = [], []
    for g in np.nonzero((m > 1) & (n > 1))[0].tolist():
        i, j, last_a, last_b = int(first_a[g]), int(first_b[g]), int(cuts_a[g]) - 1, int(cuts_b[g]) - 1
        more_a.append(i)
        more_b.append(j)
        while i < last_a or j < last_b:
            if j == last_b or (i < last_a and ends_a[i] < ends_b[j]):
                i += 1
            else:
                j += 1
            more_a.append(i)
            more_b.append(j)
    return np.r_[left, np.array(more_a, np.int64)].astype(np.int64), np.r_[right, np.array(more_b, np.int64)].astype(np.int64)


def slices_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about this many characters."""
    at = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _lists(rows: list[np.ndarray], kind=np.int32) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, kind), *rows]).astype(kind))


def align(docs: DataFrame, vocabulary: str, model: str, text: str = "text", out: tuple[str, str, str, str] = ("a_ids", "b_ids", "a_ends", "b_ends")) -> DataFrame:
    """Add the ids of every whole text under both tokenizers and, for each group, how many ids of each come before its end.

    A is a byte-level file of the tokenizers library and encodes a blank and the text; B is a sentencepiece model,
    which adds the blank itself. Spellings of special tokens are plain text. Null and empty texts, and those whose
    bytes either tokenizer doesn't keep, have empty lists. The text column is dropped; others, of any name and type,
    pass through; repeated rows are aligned alike; an empty table has no rows. Texts of any length are aligned whole.
    """
    rest = [c for c in docs.columns if c not in (text, *out)]
    packed = docs.select(F.struct(*[quoted(c) for c in rest]).alias("rest") if rest else F.lit(None).cast("int").alias("rest"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(vocabulary, model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices_of([len(t or "") for t in texts], SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(i, j - i), *memory.align(texts[i:j])], ["rest", "a", "b", "a_to", "b_to"])

    ints = T.ArrayType(T.IntegerType())
    made = packed.mapInArrow(run, T.StructType([packed.schema["rest"], *[T.StructField(c, ints) for c in ("a", "b", "a_to", "b_to")]]))
    return made.select(*[F.col("rest").getField(c).alias(c) for c in rest], *[F.col(c).alias(o) for c, o in zip(("a", "b", "a_to", "b_to"), out, strict=True)])


_BLOCKS = "block long, doc_id {0}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, pairs array<long>, docs array<int>"


def _blocks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Rows of documents, and one of each block: its distinct ``pairs`` (A's id times 2^32 plus B's) with their numbers of ``docs``.

    A document's ``steps`` lead from each of its pairs in the block's list to the next; ``times`` are its links of each.
    """
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    schema = _BLOCKS.format(docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memory = remembered(vocabulary, model)
        block, held, pairs, n_pairs = TaskContext.get().partitionId() << 32, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            distinct, at, docs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_inverse=True, return_counts=True)
            cuts = np.cumsum([0, *map(len, pairs)])
            steps = [np.diff(at[p:q], prepend=0) for p, q in pairwise(cuts)]
            ids, n_a, n_b, n_groups, n_links, sha, times = zip(*held, strict=True)
            n = len(held)
            longs = lambda v: pa.array([*v, None], pa.int64())
            columns = {
                "block": pa.array(np.full(n + 1, block)), "doc_id": pa.array([*ids, None], id_type), "n_a": longs(n_a), "n_b": longs(n_b), "n_groups": longs(n_groups), "n_links": longs(n_links),
                "groups_sha256": pa.array([*sha, None], pa.string()), "steps": _lists([*steps, distinct[:0]]), "times": _lists([*times, distinct[:0]]),
                "pairs": _lists([*[distinct[:0]] * n, distinct], np.int64), "docs": _lists([*[distinct[:0]] * n, docs]),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

        for batch in batches:
            id_type, ids, texts = batch.schema.field("doc_id").type, batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = pc.utf8_length(texts).fill_null(0).to_pylist()
            for i, j in slices_of(sizes, SLICE_CHARS):
                for doc_id, (*numbers, own, times) in zip(ids[i:j], memory.counted(texts.slice(i, j - i).to_pylist()), strict=True):
                    if n_pairs and n_pairs + len(own) > BLOCK_PAIRS:
                        yield from done()
                        block, held, pairs, n_pairs = block + 1, [], [], 0
                    held.append((doc_id, *numbers, times))
                    pairs.append(own)
                    n_pairs += len(own)
        yield from done()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: how many documents hold a pair of ids linked, and whether that is the most of its A id."""
    counts = _of_blocks(blocks).groupBy("pair").agg(F.sum("docs").alias("count"))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _of_blocks(blocks: DataFrame) -> DataFrame:
    """``(block, at, pair, docs)``: the pairs of each block with their place in its list."""
    rows = blocks.where("groups_sha256 is null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "of"))
    return rows.select("block", "at", F.col("of.pairs").alias("pair"), F.col("of.docs").alias("docs"))


def alignment_report(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """The op11 contract, from the same groups as :func:`align`'s, in one pass over the texts: a row for each document, repeated rows (each counts as a document) included.

    Null and empty texts, and those that a tokenizer doesn't keep, have zeros and an empty digest. A null doc_id is
    an id like any other; a very long text is a block of its own; an empty table has no rows; other columns are ignored.
    """
    blocks = stored(_blocks(docs, vocabulary, model))
    texts = blocks.where("groups_sha256 is not null")
    counted = _of_blocks(blocks).join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "at", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def total(held: pa.Table, known: pa.Table) -> pa.Table:
        count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        at = known.column("at").to_numpy()
        count[at], best[at] = known.column("count").to_numpy(), known.column("best").to_numpy()
        held = held.combine_chunks()
        if not held.num_rows:
            return pa.table([held.column(c) if c in held.column_names else pa.array([], pa.int64()) for c in names], names)
        steps, times = (held.column(c).chunk(0) for c in ("steps", "times"))
        cuts = steps.offsets.to_numpy()
        places, times = np.cumsum(steps.values.to_numpy()[cuts[0] : cuts[-1]].astype(np.int64)), times.values.to_numpy()[cuts[0] : cuts[-1]]
        cuts = (cuts - cuts[0])[:-1]
        places -= np.repeat(np.r_[0, places[cuts[1:] - 1]], np.diff(np.r_[cuts, len(places)]))
        made = {"n_best": np.add.reduceat(times * best[places], cuts), "count_sum": np.add.reduceat(times * count[places], cuts)}
        return pa.table([pa.array(made[c]) if c in made else held.column(c) for c in names], names)

    linked = texts.where("n_links > 0").drop("pairs", "docs").groupBy("block").cogroup(counted.groupBy("of_block"))
    done = linked.applyInArrow(total, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    zero = F.lit(0).cast("long")
    return done.unionByName(texts.where("n_links = 0").withColumns({"n_best": zero, "count_sum": zero}).select(*names))
