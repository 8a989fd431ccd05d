"""BPE encoding and decoding of whole texts with public vocabularies.

Texts of up to two leaves are encoded where they are. A longer text is cut at the spellings of special
tokens, and each piece in halves down to leaves, which are rows of their own, spread over all tasks and
encoded in parallel; neighbouring results then join up a tree: a growing window around each join is
encoded again until it meets token boundaries that both sides share (see :func:`join_halves` for why
that is exact). Leaves travel to their tree as ids alone, which spell their text; the first leaf of a
text brings the row's other columns along.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import quoted, stored

LEAF_CHARS = 8_192
# Fixed value: the pattern by which byte-level vocabularies of this family split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Places that the pattern splits at, whatever stands around them.
_SAFE_CUT = re.compile(r"(?<=[\w!-~])(?=[ \n\t\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_RUN_MARGIN = 12


class ByteEncoder:
    """Encodes texts under a byte-level BPE file of the tokenizers library, with tiktoken's merge loop.

    Ids have to rise with the order of the merges, which is checked; then they serve as ranks.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        file = json.loads(self.library.to_str())
        if file["normalizer"] or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level vocabulary")
        vocab, made = file["model"]["vocab"], ["".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
        ids = [vocab[m] for m in made]
        if ids != sorted(ids):
            raise ValueError("ids don't follow the order of the merges")
        self.bytes = token_bytes(self.library)
        self.sizes = np.array([len(x) for x in self.bytes])
        self.packed = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens have to be spelled as they are")
        self.specials = {t.content: i for i, t in added.items()}
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in self.specials}
        self.fast = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> list[str]:
        """The text cut at special tokens' spellings, which are pieces of their own."""
        if self.special is None or not any(x in text for x in self.specials):
            return [text]
        return [p for p in self.special.split(text) if p]

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, in which special tokens' spellings are those tokens."""
        made = [np.array([self.specials[p]], np.uint32) if p in self.specials else self.fast.encode_to_numpy(p, disallowed_special=()) for p in self.pieces(text)]
        return made[0] if len(made) == 1 else np.concatenate([np.zeros(0, np.uint32), *made])

    def spelled(self, ids: np.ndarray) -> str:
        """The text of these ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder for each vocabulary and worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def token_bytes(library) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    size = library.get_vocab_size(with_added_tokens=True)
    added = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    return [added[i].encode() if i in added else bytes(to_byte[c] for c in library.id_to_token(i) or "") for i in range(size)]


def _tail_bounds(lengths: np.ndarray, n_bytes: int) -> dict[int, int]:
    """Token boundaries in the last ``n_bytes``: distance from the end in bytes -> number of tokens after it."""
    out, done, i = {0: 0}, 0, 0
    while done < n_bytes and i < len(lengths):
        i += 1
        done += int(lengths[-i])
        out[done] = i
    return out


def join_halves(enc: ByteEncoder, a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """The tokens of two neighbouring texts together, from the tokens of each.

    A window of characters on each side of the join, doubled until it succeeds, is encoded again.
    The sides agree when the window's tokens and theirs share a boundary on the left and on the right:

    * a place where the pre-tokenizer splits in any context (a blank after a visible character, a
      letter next to a digit): what follows doesn't depend on what precedes; or
    * inside one unsplit run, a boundary before which both have the same token. All neighbouring
      tokens of the result then are neighbours in an encoding of the same run (of the left text,
      the window, or the right text), and a sequence is the encoding of a run if and only if each
      two neighbours encode as themselves.

    If the window reaches both ends, it is the whole text.
    """
    (ta, ia), (tb, ib), sizes = a, b, enc.sizes
    w = 64
    while w < max(len(ta), len(tb)):
        x, y = ta[-w:], tb[:w]
        bounds_a = _tail_bounds(sizes[ia], len(x.encode()))
        bounds_b = _tail_bounds(sizes[ib][::-1], len(y.encode()))
        left = 0 if len(x) == len(ta) else next((m.start() for m in _SAFE_CUT.finditer(x) if m.start()), None)
        right = len(y) if len(y) == len(tb) else next((m.start() for m in reversed(list(_SAFE_CUT.finditer(y))) if m.start()), None)
        if left is not None and right is not None:
            after, before = bounds_a.get(len(x[left:].encode())), bounds_b.get(len(y[:right].encode()))
            if after is not None and before is not None:
                mid = enc.whole(x[left:] + y[:right])
                return ta + tb, np.concatenate([ia[: len(ia) - after], mid, ib[before:]])
        elif len(enc.library.pre_tokenizer.pre_tokenize_str(x + y)) == 1:
            mid = enc.whole(x + y)
            at = np.cumsum(sizes[mid])
            nx, ny = len(x.encode()), len(y.encode())
            lefts = [(i + 1, bounds_a[nx - e]) for i, e in enumerate(at) if _RUN_MARGIN < e < nx and nx - e in bounds_a and ia[len(ia) - bounds_a[nx - e] - 1] == mid[i]]
            rights = [(i, bounds_b[e - nx]) for i, e in enumerate(np.r_[0, at[:-1]]) if nx < e < nx + ny - _RUN_MARGIN and e - nx in bounds_b and ib[bounds_b[e - nx]] == mid[i]]
            if lefts and rights:
                (i, after), (j, before) = lefts[0], rights[-1]
                return ta + tb, np.concatenate([ia[: len(ia) - after], mid[i:j], ib[before:]])
        w *= 2
    return ta + tb, enc.whole(ta + tb)


def join_tree(enc: ByteEncoder, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    while len(parts) > 1:
        parts = [join_halves(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][1]


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32))


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def leaves_of(enc: ByteEncoder, text: str, leaf_chars: int) -> Iterator[tuple[int, int, str]]:
    """``(piece, leaf, part)``: the text's pieces, each in 1, 2, 4, ... parts of ``leaf_chars`` characters or fewer."""
    for i, piece in enumerate(enc.pieces(text)):
        n = 1 << max(0, (-(-len(piece) // leaf_chars) - 1).bit_length())
        cuts = [len(piece) * j // n for j in range(n + 1)]
        for j in range(n):
            yield i, j, piece[cuts[j] : cuts[j + 1]]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", leaf_chars: int = LEAF_CHARS, decoded: str | None = None) -> DataFrame:
    """Add ``out``, the ids (``array<int>``) of every whole text under a byte-level BPE vocabulary file.

    As the tokenizers library encodes with ``add_special_tokens=False`` and no truncation or
    padding. Null texts count as empty and have no ids; repeated rows are encoded alike; an empty table
    has no rows; other columns, of any name and type, pass through. Texts of more than two leaves take the tree. With ``decoded``, a
    column of that name has what :func:`decode` makes of the ids, by the same Python worker.
    """
    rest = [c for c in docs.columns if c not in (text, out)]
    packed = docs.select(F.struct(*[quoted(c) for c in rest]).alias("rest") if rest else F.lit(None).cast("int").alias("rest"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    tall = F.length("text") > 2 * leaf_chars

    def made(enc: ByteEncoder, rests: pa.Array, texts: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        back = [pa.array(map(enc.spelled, ids), pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays([rests, texts, _ids_array(ids), *back], ["rest", "text", "ids", "decoded"][: 3 + len(back)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                part = batch.slice(a, b - a)
                yield made(enc, part.column(0), part.column(1), [enc.whole(t) for t in texts[a:b]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i, (row, t) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text"), strict=True)):
                pieces, leaf, parts = zip(*leaves_of(enc, t.as_py(), leaf_chars), strict=True)
                own = batch.column("rest").slice(i, 1)
                own = pa.concat_arrays([own, pa.nulls(len(parts) - 1, own.type)])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts)), pa.array(pieces, pa.int32()), pa.array(leaf, pa.int32()), own, pa.array(parts, pa.string())], ["row", "piece", "leaf", "rest", "part"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("part").to_pylist()
            for a, b in _slices(texts):
                ids = [enc.whole(t).astype(enc.packed).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:4], pa.array(ids, pa.binary())], ["row", "piece", "leaf", "rest", "ids"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                pieces: dict[int, list] = {}
                for p in batch.column("parts")[i].as_py():
                    ids = np.frombuffer(p["ids"], enc.packed).astype("<u4")
                    pieces.setdefault(p["piece"], []).append((enc.spelled(ids), ids))
                ids = np.concatenate([join_tree(enc, parts) for parts in pieces.values()])
                whole = "".join(p for parts in pieces.values() for p, _ in parts)
                yield made(enc, batch.column("rest").slice(i, 1), pa.array([whole], pa.string()), [ids])

    from pyspark.sql import types as T

    back = [T.StructField("decoded", T.StringType())] if decoded else []
    keys = [T.StructField("row", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("leaf", T.IntegerType()), T.StructField("rest", packed.schema["rest"].dataType)]
    done = packed.where(~tall).mapInArrow(short, T.StructType([*_schema(packed.schema, "rest", "text"), *back]))
    long = stored(packed.where(tall).withColumn("row", F.monotonically_increasing_id()))  # written once, so that row numbers stay
    rows = long.mapInArrow(cut, T.StructType([*keys, T.StructField("part", T.StringType())])).repartition("row", "piece", "leaf")
    joined = (
        rows.mapInArrow(leaves, T.StructType([*keys, T.StructField("ids", T.BinaryType())]))
        .groupBy("row")
        .agg(F.first("rest", ignorenulls=True).alias("rest"), F.sort_array(F.collect_list(F.struct("piece", "leaf", "ids"))).alias("parts"))
        .mapInArrow(trees, T.StructType([*_schema(long.schema, "rest", "text"), *back]))
    )
    both = done.unionByName(joined)
    return both.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("text").alias(text), F.col("ids").alias(out), *[F.col("decoded").alias(decoded) for _ in back])


def _schema(schema, *names):
    from pyspark.sql import types as T

    return T.StructType([schema[n] for n in names] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of the ids, special tokens included, as the library decodes them (broken UTF-8 becomes U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            values, ends = col.values.to_numpy(), col.offsets.to_numpy()
            texts = [enc.spelled(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.drop(out).schema.fields, T.StructField(out, T.StringType())]))


def roundtrip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The digest columns of the op8 contract; null and empty texts have no token, an empty table has no row."""
    back = encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
