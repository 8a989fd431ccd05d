"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams and of itself, all hashed into one
table, so that unseen misspellings share most of their vectors with the words they stand for. A
passage of a few words is the average of its words; a softmax over it tells toxic from clean, and a
text's score is the softmax's probability for its worst passage. Training alternates between choosing
each text's passages and gradient steps on table and softmax together; texts held back for it then set
the softmax's temperature and bias. Being linear, the trained model is one number for each place of the
table (the difference of its two logits) and that bias, which is what tasks get. The sample is learnt from
in a task, so that the driver meets no text, only the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import quoted, unused

BUCKET_BITS = 17
NGRAMS = (3, 4, 5)
PASSAGE_WORDS = 8
#: N-grams of fewer training texts have no vector.
LEAST_TEXTS = 4
#: Bounds of the training sample: labelled rows of each class, by the hash of their ids, and as many pieces of
#: PIECE_CHARS of their texts. Texts of any length are drawn; longer ones have more pieces. Scoring has no bound.
MOST_TOXIC, MOST_CLEAN, PIECE_CHARS = 2000, 4000, 20_000
FOLDS = 5
#: Words whose n-grams are looked up together in training, which bounds what they take.
WORDS_AT_ONCE = 20_000
_EDGES = ".,;:!?\"'()[]{}<>|*#%&$-_/\\+=~^`@…“”„«»’"


@dataclass
class Model:
    weights: np.ndarray  # the difference of the softmax's logits for each place of the table, by its temperature
    bias: float


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of all n-grams of all words, and the word that each belongs to."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes to the end of the word
    places, owners = [np.array([zlib.crc32(r) for r in raw], dtype=np.uint32)], [np.arange(len(raw))]
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        h[: len(data) - n + 1] = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in NGRAMS:
            inside = left >= n
            places.append(h[inside])
            owners.append(owner[inside])
    mixed = np.concatenate(places) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.concatenate(owners)


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    places, owners = subwords(words)
    return np.bincount(owners, weights[places], len(words)) / np.bincount(owners, minlength=len(words))


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def worst_passage(scores: np.ndarray) -> tuple[float, int]:
    """The highest average of any run of PASSAGE_WORDS words, and where it starts.

    A word that follows itself counts once; fewer words are filled up with zeros, as in training.
    """
    if not len(scores):
        return 0.0, 0
    places = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
    sums = np.concatenate([[0.0], np.cumsum(scores[places])])
    n = min(len(places), PASSAGE_WORDS)
    means = (sums[n:] - sums[:-n]) / PASSAGE_WORDS
    at = int(np.argmax(means))
    return float(means[at]), at


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], labels: list[int], dim: int = 8, rounds: int = 14, seed: int = 7) -> Model:
    """Fit on labelled texts. A fifth of them only sets the softmax's temperature and bias."""
    return learn(zip(texts, labels, strict=True), dim, rounds, seed)


def learn(rows: Iterable[tuple[str, int]], dim: int = 8, rounds: int = 14, seed: int = 7) -> Model:
    """Fit on texts and their labels, each of which is met once: only the numbers of its words are kept."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs, labels = [], []
    for t, label in rows:
        d = np.array([vocab.setdefault(w.strip(_EDGES) or w, len(vocab)) for w in split(t)], dtype=np.int32)
        docs.append(d[np.concatenate([[True], d[1:] != d[:-1]])] if len(d) else d)
        labels.append(label)
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:  # nothing to tell apart: the score is the one label there is
        return Model(np.zeros(1 << BUCKET_BITS), 0.0 if not labels else (9.0 if labels[0] else -9.0))
    names, made, sizes_of = list(vocab), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    n_words = len(names)
    del vocab
    for i in range(0, n_words, WORDS_AT_ONCE):
        part, owners = subwords(names[i : i + WORDS_AT_ONCE])
        made.append(part[np.argsort(owners, kind="stable")].astype(np.int32))
        sizes_of.append(np.bincount(owners))
    places, counts = np.concatenate(made), np.concatenate(sizes_of)
    begins = np.r_[0, np.cumsum(counts)]
    del names, made, sizes_of
    blocks = [(i, min(i + WORDS_AT_ONCE, n_words)) for i in range(0, n_words, WORDS_AT_ONCE)]
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_table, seen_soft, seen_bias = np.full(1 << BUCKET_BITS, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    held = rng.random(len(docs)) < 1 / FOLDS
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    # In how many toxic and clean texts a word is: what few texts have would only be learnt by heart, and
    # the words that toxic texts have too often say which passages to begin with.
    within = np.zeros((2, n_words), np.int64)
    for d, h, t in zip(docs, held, y, strict=True):
        if not h:
            within[t, np.unique(d)] += 1
    total = [max(1, int((y[~held] == c).sum())) for c in (0, 1)]
    rate = (within[0] + within[1]) / sum(total)
    excess = (within[1] / total[1] - within[0] / total[0]) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / total[0] + 1 / total[1]))
    common = np.zeros(1 << BUCKET_BITS)
    for i, j in blocks:
        common += np.bincount(places[begins[i] : begins[j]], np.repeat(within[0, i:j] + within[1, i:j], counts[i:j]), 1 << BUCKET_BITS)
    common = common >= LEAST_TEXTS
    table[~common] = 0

    def scores_of(weights: np.ndarray) -> np.ndarray:
        small = weights.astype(np.float32)
        sums = [np.add.reduceat(small[places[begins[i] : begins[j]]], begins[i:j] - begins[i]) for i, j in blocks]
        return np.concatenate(sums) / counts if sums else np.zeros(0)

    def passages(round_: int, scores: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        rows, own = [], []
        for i, d in enumerate(docs):
            if held[i] or not len(d):
                continue
            # toxic texts teach by their worst passage; clean ones by it and by others
            worst = worst_passage((excess if round_ < 3 else scores)[d])[1]
            others = rng.integers(0, max(1, len(d) - PASSAGE_WORDS + 1), 2)
            starts = [worst] if y[i] else [worst, *others]
            rows += [d[s : s + PASSAGE_WORDS] for s in starts]
            own += [int(y[i])] * len(starts)
        return rows, own

    for round_ in range(rounds):
        rows, own = passages(round_, scores_of(table @ (soft[:, 1] - soft[:, 0])))
        own = np.array(own)
        share = {c: len(own) / (2 * max(1, int((own == c).sum()))) for c in (0, 1)}
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512, min(20, len(rows) // 16))):
            words = np.concatenate([rows[i] for i in batch])
            lengths = np.array([len(rows[i]) for i in batch])
            uniq, inverse = np.unique(words, return_inverse=True)
            sizes = counts[uniq]
            firsts = np.r_[0, np.cumsum(sizes)[:-1]]
            grams = places[np.repeat(begins[uniq] - firsts, sizes) + np.arange(sizes.sum())]
            vectors = np.add.reduceat(table[grams], firsts, axis=0) / sizes[:, None]
            heads = np.r_[0, np.cumsum(lengths)[:-1]]
            bag = np.add.reduceat(vectors[inverse], heads, axis=0) / PASSAGE_WORDS
            logits = bag @ soft + bias
            prob = _logistic(logits[:, 1] - logits[:, 0])
            weight = np.where(own[batch] == 1, share[1], share[0]) / len(batch)
            slope = ((prob - own[batch]) * weight).astype(np.float32)
            to_logits = np.stack([-slope, slope], axis=1)
            to_bag = to_logits @ soft.T
            to_words = np.zeros_like(vectors)
            np.add.at(to_words, inverse, np.repeat(to_bag / PASSAGE_WORDS, lengths, axis=0))
            to_grams = np.repeat(to_words / sizes[:, None], sizes, axis=0)
            hit, back = np.unique(grams, return_inverse=True)
            to_table = np.stack([np.bincount(back, to_grams[:, j], len(hit)) for j in range(dim)], axis=1).astype(np.float32) + 1e-6 * table[hit]
            seen_table[hit] += (to_table**2).mean(axis=1)
            table[hit] -= 0.3 * common[hit, None] * to_table / np.sqrt(seen_table[hit])[:, None]
            to_soft = bag.T.astype(np.float32) @ to_logits
            seen_soft += to_soft**2
            soft -= 0.05 * to_soft / np.sqrt(seen_soft)
            seen_bias += to_logits.sum(axis=0) ** 2
            bias -= 0.05 * to_logits.sum(axis=0) / np.sqrt(seen_bias)
    weights = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
    scores = scores_of(weights)
    own = held if held.any() else np.ones(len(docs), bool)
    x = np.array([worst_passage(scores[d])[0] for d, h in zip(docs, own, strict=True) if h])
    temperature, bias = _calibrate(x, y[own])
    return Model(weights * temperature, bias)


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """The (inverse) temperature and the bias that make the softmax fit the labels of held-back texts best, by damped Newton steps."""
    spread = float(x.std()) or 1.0
    z, w = (x - x.mean()) / spread, np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(steps):
        p = _logistic(design @ w)
        grad = design.T @ (p - y) + np.array([0.05, 0.0]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.05, 1e-3])
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / spread), float(w[1] - w[0] * x.mean() / spread)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of labelled documents whose crc32(doc_id as text) mod 5 isn't 0.

    Of documents that repeat an id, the least text is taken; null texts count as empty. Texts are drawn whatever their
    length, in pieces; of the pieces, as many of each class as rows are taken by their hash, so that a very long text
    has part in the sample without making it longer. The pieces of a text are one text to learn from. One task learns
    from the sample, text by text, and returns the model (1 MB), which alone comes to the driver.
    """
    train_rows = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = train_rows.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(train_rows.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    picked = docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    text = F.coalesce("text", F.lit(""))
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0)))
    pieces = picked.select("doc_id", "toxic", F.posexplode(cut).alias("at", "piece"))
    drawn = [F.xxhash64("doc_id", "at"), "doc_id", "at"]
    both = pieces.where("toxic = 1").orderBy(*drawn).limit(MOST_TOXIC).unionByName(pieces.where("toxic = 0").orderBy(*drawn).limit(MOST_CLEAN))  # 6 000 pieces of 20 000 characters at most
    parts = both.repartition(1).sortWithinPartitions("doc_id", "toxic", "at").select(F.struct("doc_id", "toxic").alias("own"), F.col("toxic").cast("int").alias("label"), "piece")
    made = parts.mapInArrow(_learnt, "weights binary, bias double").collect()
    return Model(np.frombuffer(made[0].weights), made[0].bias) if made else learn([])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the pieces of all texts, those of a text in their order and next to each other."""
    pieces = ((own.as_py(), label.as_py(), piece.as_py()) for batch in batches for own, label, piece in zip(*batch.columns, strict=True))
    model = learn(("\n".join(p for _, _, p in text), label) for (_, label), text in groupby(pieces, lambda x: x[:2]))
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([float(model.bias)], pa.float64())], ["weights", "bias"])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", words_kept: int = 400_000) -> DataFrame:
    """Add ``out``, the toxicity of every whole text from 0 to 1; null and empty texts get the score of no words.

    Other columns pass through and repeated rows score alike. The model (one number for each of
    2^17 places) goes to the tasks whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, out)]
    packed = docs.select(F.struct(*[quoted(c) for c in rest]).alias("rest"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                part = [split(t.as_py()) for t in texts.slice(at, 256)]
                new = list(set().union(*part).difference(known))
                if len(known) + len(new) > words_kept:
                    known, new = {}, list(set().union(*part))
                for i in range(0, len(new), 20_000):
                    own = new[i : i + 20_000]
                    known.update(zip(own, word_scores([w.strip(_EDGES) or w for w in own], m.weights).tolist(), strict=True))
                worst = np.array([worst_passage(np.fromiter(map(known.__getitem__, p), np.float64, len(p)))[0] for p in part])
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(at, 256), texts.slice(at, 256), pa.array(_logistic(worst + m.bias))], ["rest", "text", "score"])

    from pyspark.sql import types as T

    made = packed.mapInArrow(run, T.StructType([packed.schema["rest"], packed.schema["text"], T.StructField("score", T.DoubleType())]))
    return made.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("text").alias(text), F.col("score").alias(out))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op4 contract; null and empty texts score as texts of no words, repeated rows alike, an empty table has no row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5, with all their columns, whatever their names.

    Null and empty texts score as texts of no words, very long ones are scored whole, rows that repeat stay or
    go together, and empty tables are borne (without labels of both kinds, all documents get one score).
    """
    (own,) = unused(docs, "score")
    return score(docs, fit(docs, labels), out=own).where(F.col(own) < 0.5).select(*[quoted(c) for c in docs.columns])
