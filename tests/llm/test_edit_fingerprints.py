"""Fingerprints by edit embedding: the walk step by step, the next document, likeness, bands."""

import hashlib
import random

import numpy as np
from odd_rows import ODD

from twigmer.llm import edit_fingerprints as ef


def embedding(text):
    """The embedding by definition: the character that the walk stands on at each step."""
    moves = (ef._mixed(np.arange(256 * ef._PERIOD, dtype=np.uint64) + np.uint64(1 << 32)) >> np.uint64(63)).reshape(256, ef._PERIOD)
    out, i = [], 0
    while i < len(text):
        c = ord(text[i])
        out.append(text[i])
        i += int(moves[(c ^ (c >> 8)) & 255, (len(out) - 1) % ef._PERIOD])
    return out


def naive(text):
    steps = embedding(text)
    level = 0
    while 2 * len(text) > 2 * ef.SAMPLES << level:
        level += 1
    bit = lambda p: int(ef._mixed(np.array([(p << 24) ^ (p >> 40) ^ ord(steps[p])], np.uint64))[0]) >> 63
    places = [p for p in range(len(steps)) if (p - ef._GRID) % (1 << level) == 0]
    return level, len(steps), {p: bit(p) for p in places}


def naive_likeness(a, b):
    grid = lambda x: {p: v for p, v in x[2].items() if (p - ef._GRID) % (1 << max(a[0], b[0])) == 0}
    x, y = grid(a), grid(b)
    most = max(len(x), len(y))
    if not most:
        return float(a[1] == b[1])
    apart = sum(x[p] != y[p] for p in x.keys() & y.keys()) + (most - min(len(x), len(y))) / 2
    return max(0.0, 1 - 2 * apart / most)


def digits(n):
    level, steps, bits = n
    return f"{level:x}.{steps:x}.{np.packbits([bits[p] for p in sorted(bits)] or np.zeros(0, np.uint8)).tobytes().hex()}"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_report_equals_naive_recomputation(spark, docs, monkeypatch):
    monkeypatch.setattr(ef, "_CHARS", 1000)  # several pieces of a walk
    rng = random.Random(5)
    more = [(2000 + i, prose(rng, rng.randint(1, 900))) for i in range(25)] + [(-5, prose(rng, 9000)), (None, "tail"), (7777, ""), (7776, None)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).collect()
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, fingerprint string, part int").repartition(5)
    got = ef.fingerprint_report(frame).collect()
    assert len(got) == len(rows)
    # those that share an id may stand in any order, that of a hash of their texts
    keys = {(r.doc_id, r.text or ""): h for r, h in zip(rows, hashes(spark, rows), strict=True)}
    order = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), keys[x]))
    made = {t: naive(t) for _, t in order}
    want = []
    for (doc_id, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        prints = made[text], naive(new), made[after]
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digits(prints[0]), digits(prints[1]), round(naive_likeness(*prints[:2]), 12), round(naive_likeness(prints[0], prints[2]), 12)))
    assert sorted(((*r[:5], round(r.near_edited, 12), round(r.near_next, 12)) for r in got), key=str) == sorted(want, key=str)


def hashes(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, r.text or "") for i, r in enumerate(rows)], "i long, text string")
    return [r.h for r in frame.select("i", F.xxhash64("text").alias("h")).orderBy("i").collect()]


def test_no_rows_and_a_lone_one(spark):
    frame = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    (one,) = ef.fingerprint_report(frame).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0 and one.component_id == 1
    assert ef.fingerprint_report(frame.limit(0)).count() == 0


def test_edits_are_near_and_others_are_not():
    rng = random.Random(6)
    for n in (40, 300, 3000):
        text, other = prose(rng, n), prose(rng, n)
        words = text.split(" ")
        words[n // 3] = "inserted words"
        del words[n // 2]
        near = ef.fingerprint(text).likeness(ef.fingerprint(" ".join(words)))
        assert ef.fingerprint(text).likeness(ef.fingerprint(text)) == 1.0
        assert near > (0.5 if n == 40 else 0.85) and ef.fingerprint(text).likeness(ef.fingerprint(other)) < 0.35
    assert ef.fingerprint("").likeness(ef.fingerprint(None)) == 1.0 and ef.fingerprint("").likeness(ef.fingerprint("a")) == 0.0


def test_strings_keep_fingerprints():
    for text in [t for t in ODD if t] + ["", "a" * 5001]:
        p = ef.fingerprint(text)
        q = ef.Fingerprint.parse(p.text())
        assert (q.level, q.steps, q.bits.tolist()) == (p.level, p.steps, p.bits.tolist()) and len(p.bits) <= 1400
        assert (ef._from_payload(ef._payload(p)).bits == p.bits).all()


def test_near_copies_equal_all_pairs(spark):
    """Components of all pairs at the bound, and not one document in another."""
    rng = random.Random(7)
    rows = []
    for i in range(50):
        words = prose(rng, rng.choice([30, 200, 700])).split(" ")
        for k in range(4):
            own = list(words)
            for _ in range(k and max(1, len(words) // 200)):
                own[rng.randrange(len(own))] = "x"
            rows.append((10 * i + k, " ".join(own)))
    base = prose(rng, 400).split(" ")
    rows += [(1000 + k, " ".join([*base[: (p := rng.randrange(400))], f"v{k}", *base[p + 1 :]])) for k in range(60)]
    rows += [(2000, ""), (2001, None), (2002, rows[0][1])]
    prints = {d: ef.fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if prints[a].likeness(prints[b]) >= ef.SIMILAR]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in ef.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 900 and together >= 0.99 * len(pairs)
    assert all(find(got[d]) == find(d) for d in ids) and got[2001] == 2000 and got[2002] == 0
