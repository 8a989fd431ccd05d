"""Repeated paragraphs across documents: MinHash banding, exact verification, components.

Paragraphs are of two kinds.

* Lines of ``min_line_words`` words or more (5, a shingle). Their sets of 5-word shingles are MinHashed in bands;
  lines that share a band are verified by exact Jaccard similarity and clustered by components. Equal lines are one
  node from the start. A set of up to 3 shingles is only similar to itself, and has one band of all of it.
* All runs of ``min_words`` (51) consecutive words, across line ends. The MinHash of such a run over its 16-word
  shingles is its band, so that equal runs always collide. Neighbouring runs share their minimum: a text
  names each minimum once, some 18 words apart. Around minima that two texts share, all runs are
  compared by 128-bit digests and joined into maximal passages, so that a passage is found to the word
  wherever it stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import connected_components, quoted, stored
from .links import bucket_links, jaccard

SHINGLE_WORDS, SIMILAR = 5, 0.8
#: The least length of a passage; any value from SEED_WORDS on is exact.
MIN_WORDS = 51
#: The least length of a line; any value from SHINGLE_WORDS on is exact.
MIN_LINE_WORDS = SHINGLE_WORDS
#: Shingles by which runs of MIN_WORDS words are MinHashed.
SEED_WORDS = 16
#: 1 - (1 - 0.8^3)^8: 99.7 % of pairs at the threshold share a band.
BANDS, ROWS = 8, 3
#: Two sets of this many elements at most are similar only if they are equal.
ALONE = 3
_rng = np.random.default_rng(20)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN, _FLIP = _odd(BANDS * ROWS), _odd(BANDS * ROWS)
_BASES = _odd(3)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tuned_bands(rows: int, similar: float = SIMILAR, recall: float = 0.995) -> int:
    """The least number of bands that finds a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))
    return _powers[base][:n]


def run_hashes(hashes: np.ndarray, k: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A hash of each run of ``k`` words, by differences of one running sum."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers_of(int(base), n), out=sums[1:])
    x = (sums[k:] - sums[:-k]) * _powers_of(pow(int(base), -1, 1 << 64), n - k + 1)
    x ^= x >> np.uint64(31)
    x *= _GOLDEN
    x ^= x >> np.uint64(29)
    return x


def _sliding(x: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each ``n`` values in a row."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = least(x[:-step], x[step:])
        size += step
    return x


def minima(x: np.ndarray, n: int) -> np.ndarray:
    """The places of the least value of each ``n`` in a row, all of them where they tie."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    low = _sliding(x, n, np.minimum)
    pad = np.zeros(n - 1, x.dtype)
    return np.nonzero(_sliding(np.r_[pad, low, pad], n, np.maximum) == x)[0]


def band_keys(x: np.ndarray, ends: np.ndarray, rows: int = ROWS, turn: np.ndarray = _TURN, flip: np.ndarray = _FLIP) -> np.ndarray:
    """The band hashes of paragraphs' shingles, one row each; every ``rows`` of the given hash functions are a band."""
    keys = np.zeros((len(ends) - 1, len(turn) // rows), np.uint64)
    for b in range(keys.shape[1]):
        for r in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat((x ^ flip[r]) * turn[r], ends[:-1])
            keys[:, b] = (keys[:, b] ^ least) * _GOLDEN + np.uint64(b + 1)
            keys[:, b] ^= keys[:, b] >> np.uint64(29)
    return keys.view(np.int64)


def lines_of(text: str, min_words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``(number, start, characters, first word, words)`` of the lines of ``min_words`` words or more."""
    at = word = 0
    for i, line in enumerate(text.split("\n")):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n >= min_words:
            yield i, at, len(line), word, n
        at, word = at + len(line) + 1, word + n


_SCAN = "text_key binary, n_words long, seed long, places array<int>, line binary, number int, start long, n_chars long, bands array<long>"
#: Texts that are hashed at once.
_GROUP = 256


def _scan(texts: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """Three sorts of rows of each text ``(text_key, text)``: its length in words, its seeds with their places, its long lines with their bands."""
    names = [x.split()[0] for x in _SCAN.split(", ")]
    kinds = {"text_key": pa.binary(), "n_words": pa.int64(), "seed": pa.int64(), "places": pa.list_(pa.int32()), "line": pa.binary(), "number": pa.int32(), "start": pa.int64(), "n_chars": pa.int64(), "bands": pa.list_(pa.int64())}

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds[c])) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            seen: set[bytes] = set()  # of a batch: copies of a text make one row there
            for at in range(0, batch.num_rows, _GROUP):
                part = batch.slice(at, _GROUP)
                new = {k: t for k, t in zip(part.column("text_key").to_pylist(), part.column("text").to_pylist(), strict=True) if k not in seen}
                seen.update(new)
                split = {k: w for k, t in new.items() if len(w := words_of(t)) >= min(min_words, min_line_words)}
                if not split:
                    continue
                hashes = word_hashes([w for words in split.values() for w in words])
                by_seed, by_shingle = run_hashes(hashes, SEED_WORDS), run_hashes(hashes, SHINGLE_WORDS)
                base, places, lines, shingles = 0, [], [], []
                for key, words in split.items():
                    places.append(minima(by_seed[base : max(base, base + len(words) - SEED_WORDS + 1)], min_words - SEED_WORDS + 1))
                    for number, start, n_chars, first, n in lines_of(new[key], min_line_words):
                        lines.append((key, n, xxhash.xxh3_128_digest(b" ".join(words[first : first + n])), number, start, n_chars))
                        shingles.append(by_shingle[base + first : base + first + n - SHINGLE_WORDS + 1])
                    base += len(words)
                lengths = np.array([len(w) for w in split.values()])
                keys = pa.array(list(split), pa.binary())
                yield batch_of(len(split), text_key=keys, n_words=pa.array(lengths))
                own = np.repeat(np.arange(len(split)), [len(p) for p in places])
                places = np.concatenate(places)
                seeds = by_seed[places + (np.cumsum(lengths) - lengths)[own]].view(np.int64)
                order = np.lexsort((places, seeds, own))  # a text's places of one seed in a row
                own, seeds, places = own[order], seeds[order], places[order]
                heads = np.nonzero(np.r_[True, (own[1:] != own[:-1]) | (seeds[1:] != seeds[:-1])])[0]
                lists = pa.ListArray.from_arrays(np.r_[heads, len(seeds)].astype(np.int32), places.astype(np.int32))
                yield batch_of(len(heads), text_key=keys.take(pa.array(own[heads])), seed=pa.array(seeds[heads]), places=lists)
                if lines:
                    bands = band_keys(np.concatenate(shingles), np.r_[0, np.cumsum([len(s) for s in shingles])])
                    alone = [i for i, s in enumerate(shingles) if len(set(s[: 2 * ALONE].tolist())) <= ALONE and len(np.unique(s)) <= ALONE]
                    kept = np.ones(bands.shape, bool)
                    for i in alone:  # equal sets have all bands in common, so that a mix of them names the set
                        kept[i, 1:], bands[i, 0] = False, np.bitwise_xor.reduce(bands[i]) ^ np.int64(BANDS)
                    ends = np.r_[0, np.cumsum(kept.sum(axis=1))].astype(np.int32)
                    columns = {c: pa.array(v, kinds[c]) for c, v in zip(["text_key", "n_words", "line", "number", "start", "n_chars"], zip(*lines, strict=True), strict=True)}
                    yield batch_of(len(lines), **columns, bands=pa.ListArray.from_arrays(ends, bands[kept]))

    return texts.mapInArrow(run, _SCAN)


def _shingle_sets(picked: DataFrame) -> DataFrame:
    """``(id, payload)``: the distinct shingles of the lines ``lines(first word, words, id)`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lines in zip(batch.column("text"), batch.column("lines"), strict=True):
                if not (rows := lines.as_py()):
                    continue
                x = run_hashes(word_hashes(words_of(text.as_py())), SHINGLE_WORDS)
                first = {number: (a, n) for number, _, _, a, n in lines_of(text.as_py() or "", 1)}
                sets = [np.unique(x[a : a + n - SHINGLE_WORDS + 1]) for a, n in (first[r["number"]] for r in rows)]
                ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64))], ["id", "payload"])

    return picked.mapInArrow(run, "id long, payload array<long>")


def _word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.r_[False, ~((chars == 32) | ((chars >= 9) & (chars <= 13))), False]
    return np.nonzero(inside[1:] & ~inside[:-1])[0], np.nonzero(inside[:-1] & ~inside[1:])[0]


def _runs(picked: DataFrame, min_words: int) -> DataFrame:
    """``(node, place, start, stop, h1, h2)``: the runs of ``min_words`` words around the seeds of each text, in characters, with their digest."""
    schema = "node long, place int, start int, stop int, h1 long, h2 long"

    def of(node: int, text: str, seeds: np.ndarray) -> list[np.ndarray]:
        hashes = word_hashes(words_of(text))
        near = np.zeros(len(hashes) + 1, np.int32)  # +1 where the runs around a seed begin, -1 behind them
        np.add.at(near, np.maximum(seeds - (min_words - SEED_WORDS), 0), 1)
        np.add.at(near, np.minimum(seeds + 1, len(hashes)), -1)
        places = np.nonzero(np.cumsum(near)[: len(hashes) - min_words + 1])[0]
        starts, stops = _word_spans(text)
        digests = [run_hashes(hashes if i == 0 else hashes * _GOLDEN ^ (hashes >> np.uint64(23)), min_words, _BASES[i + 1])[places].view(np.int64) for i in range(2)]
        return [np.full(len(places), node), places.astype(np.int32), starts[places].astype(np.int32), stops[places + min_words - 1].astype(np.int32), *digests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, n = [], 0
            for i, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)):
                if len(seeds := batch.column("seeds")[i].values):
                    made.append(of(node, text.as_py(), seeds.to_numpy()))
                    n += len(made[-1][0])
                if made and (n > 100_000 or i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], ["node", "place", "start", "stop", "h1", "h2"])
                    made, n = [], 0

    return picked.mapInArrow(run, schema)


def near_sets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of two blocks of sets have a Jaccard similarity of SIMILAR or more."""
    both = [*left, *right]
    sizes = np.array([len(s) for s in both])
    columns = np.unique(np.concatenate(both), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(both)), sizes)
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, columns.max() + 1, 4096):
        part = np.zeros((len(both), 4096), np.float32)
        here = (columns >= at) & (columns < at + 4096)
        part[rows[here], columns[here] - at] = 1
        common += part[: len(left)] @ part[len(left) :].T
    return common >= SIMILAR * (sizes[: len(left), None] + sizes[None, len(left) :] - common)


def _check_sets(sets: DataFrame):
    """The check of pairs by the exact Jaccard similarity of ``sets(id, payload)``."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("payload").alias(f"set_{c}"))
    return lambda pairs: pairs.join(side("b"), "b").join(side("a"), "a").where(jaccard(F.col("set_a"), F.col("set_b")) >= SIMILAR).select("a", "b")


def repeated_paragraphs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """The lines of ``min_line_words`` words or more, and the passages of ``min_words`` or more, that two or more documents share.

    One row for each place: ``doc_id``, ``kind``, ``number`` (of a line, from 0; else null), ``start, n_chars``
    (code points), ``n_words``, ``component`` (a name), ``component_id`` (its smallest doc_id), and ``removed``:
    false in the first document (by doc_id, nulls first; of a line repeated there, for the first), true in others; and
    ``long_repeat``: whether the document has any shared passage, text or line of ``min_words`` or more. Kinds:

    * ``line``: whole lines, linked if equal or at Jaccard similarity 0.8 or more of 5-word shingles.
    * ``passage``: maximal runs of words that are equal to a run of the first document that has them,
      wherever they stand, across line ends too.
    * ``text``: whole texts of ``min_words`` or more that are equal; a copy's passages shared with other texts are listed too.

    Words are lower-cased (A-Z) and parted by ASCII blanks. Null, empty and short texts have no paragraph, an
    empty table has no row; very long texts are searched whole. Rows of equal doc_id (or without any) and text are
    one document; repeated rows repeat their places. Columns of other names are ignored. ``min_words`` below 16 and
    ``min_line_words`` below 5 raise.
    """
    if min_words < SEED_WORDS or min_line_words < SHINGLE_WORDS:
        raise ValueError(f"min_words is {SEED_WORDS} at least, min_line_words {SHINGLE_WORDS}")
    t = F.coalesce(quoted(text), F.lit(""))
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    key = F.unhex(F.md5(t.cast("binary"))).alias("text_key")
    texts = docs.select(key, doc.alias("doc"), t.alias("text"))
    ids = docs.select("doc_id", key)
    scan = stored(_scan(texts.select("text_key", "text"), min_words, min_line_words))
    lengths = scan.where("seed is null and line is null").select("text_key", "n_words").distinct()
    nodes = ids.groupBy("text_key").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).join(lengths, "text_key")
    # texts that may have a line or passage, numbered by their first document; written once, so that numbers stay
    nodes = stored(nodes.orderBy("first", "text_key").withColumn("node", F.monotonically_increasing_id()))

    # lines of equal words are one node, which its first text stands for
    lines = scan.where("line is not null")
    names = lines.groupBy("line").agg(F.min(F.struct("text_key", "number")).alias("one"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    names = stored(names.withColumn("id", F.monotonically_increasing_id()))
    members = stored(_line_members(names.select("id", F.explode("bands").alias("key"))).select("id", "first").distinct())
    compared = members.select("id").unionByName(members.select(F.col("first").alias("id"))).distinct()
    wanted = names.join(compared, "id").groupBy("one.text_key").agg(F.collect_list(F.struct("one.number", "id")).alias("lines"))

    # seeds that two texts share; a hash of a text's key tells it apart here
    seeds = scan.where("seed is not null").select("text_key", "seed", "places")
    owner = F.xxhash64("text_key")
    shared = seeds.groupBy("seed").agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a < b").select("seed")
    around = seeds.join(shared, "seed", "left_semi").groupBy("text_key").agg(F.flatten(F.collect_list("places")).alias("seeds"))
    wanted = wanted.join(around, "text_key", "full").join(nodes.select("text_key", "node", F.col("first").alias("doc")), "text_key")
    picked = texts.join(wanted, ["text_key", "doc"]).dropDuplicates(["text_key", "doc"])  # of copies, the first document's
    none = F.array().cast("array<struct<number:int,id:bigint>>")
    picked = stored(picked.select("node", "text", F.coalesce("lines", none).alias("lines"), F.coalesce("seeds", F.array().cast("array<int>")).alias("seeds")))

    columns = ["text_key", "kind", "number", "start", "n_chars", "n_words", "component", "of", "removed"]
    found = _line_places(lines, names, members, picked, nodes).select(*columns)
    found = found.unionByName(_passages(_runs(picked.drop("lines"), min_words), nodes, min_words).select(*columns))
    chars = docs.groupBy(key).agg(F.first(F.length(t)).cast("long").alias("n_chars"))
    whole = nodes.where((F.col("first") < F.col("last")) & (F.col("n_words") >= min_words)).join(chars, "text_key")
    whole = whole.select("text_key", F.lit("text").alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(0).cast("long").alias("start"), "n_chars", "n_words", F.hex("text_key").alias("component"), F.col("first").alias("of"), F.lit(False).alias("removed"))
    found = found.unionByName(whole.select(*columns))
    # a partition is the places of one text, which the join below needs together too
    found = found.withColumn("long_repeat", F.max(F.col("n_words") >= min_words).over(Window.partitionBy("text_key")))
    of = F.when(F.col("of") != F.lit(-(1 << 63)), F.col("of"))
    rows = found.join(ids, "text_key").withColumn("removed", F.col("removed") | (doc != F.col("of")))
    return rows.select("doc_id", "kind", "number", "start", "n_chars", "n_words", "component", of.alias("component_id"), "removed", "long_repeat")


def _line_members(buckets: DataFrame) -> DataFrame:
    """As :func:`.links.members_of`, of ids that have each key once: a bucket's size is told by a count, which takes less room than its last id."""
    ends = buckets.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    return buckets.join(ends, "key").where("id <> first")


def _line_places(lines: DataFrame, names: DataFrame, members: DataFrame, picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The places of lines whose component two documents have."""
    sets = stored(_shingle_sets(picked.select("text", "lines")))
    roots = connected_components(bucket_links(members, _check_sets(sets), lambda ids: sets, near_sets))
    near = (F.col("n") > 1) | F.col("root").isNotNull()
    named = names.select("line", "id", "n").join(roots, "id", "left").select("line", F.coalesce("root", "id").alias("root"), near.alias("near"))
    # other lines only stand in one document, unless the whole text is copied
    rows = lines.select("text_key", "line", "number", "start", "n_chars", "n_words")
    copied = rows.join(nodes.where("first < last").select("text_key"), "text_key", "left_semi").join(named.where("not near"), "line")
    places = rows.join(named.where("near"), "line").unionByName(copied).drop("line", "near").distinct()
    places = stored(places.join(nodes.select("text_key", "node", "first", "last"), "text_key"))
    # nodes are numbered by their first document
    groups = places.groupBy("root").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(F.col("first") < F.col("last")).alias("copied"))
    groups = groups.where("low < high or copied").select("root", "low")
    origins = nodes.select(F.col("node").alias("low"), F.col("first").alias("of"))
    rows = places.join(groups, "root").join(origins, "low")
    # in its first document, a component's first line stays
    head = rows.where("node = low").groupBy("root").agg(F.min("number").alias("head"))
    removed = (F.col("node") != F.col("low")) | (F.col("number") != F.col("head"))
    return rows.join(head, "root").select("text_key", F.lit("line").alias("kind"), "number", "start", "n_chars", "n_words", F.concat(F.lit("line "), F.col("root")).alias("component"), "of", removed.alias("removed"))


def _passages(runs: DataFrame, nodes: DataFrame, min_words: int) -> DataFrame:
    """Maximal passages: neighbouring runs that two texts share, while the first text that has them stays the same."""
    # nodes are numbered by their first document
    classes = runs.groupBy("h1", "h2").agg(F.min("node").alias("origin"), F.max("node").alias("high")).where("origin < high").drop("high")
    rows = runs.join(classes, ["h1", "h2"]).select("node", "place", "start", "stop", "origin")
    # a partition is a part of one text
    row = F.row_number().over(Window.partitionBy("node", "origin").orderBy("place"))
    chains = rows.withColumn("chain", F.col("place") - row).groupBy("node", "origin", "chain")
    made = chains.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"))
    made = made.join(nodes.select("node", "text_key"), "node").join(nodes.select(F.col("node").alias("origin"), F.hex("text_key").alias("component"), F.col("first").alias("of")), "origin")
    return made.select(
        "text_key", F.lit("passage").alias("kind"), F.lit(None).cast("int").alias("number"), F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("n_chars"),
        (F.col("n") + min_words - 1).alias("n_words"), "component", "of", (F.col("origin") != F.col("node")).alias("removed"),
    )
