"""Hard negatives against brute force, with odd rows and several cells."""

import math
import random

import duckdb
import numpy as np
import pytest

from twigmer.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, q int"


def brute_force(rows):
    """The op12 contract by definition; ``rows(vec_id, embedding, label)`` without repeats that tie."""
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept.append((vec_id, q, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        score = [sum(p * q for p, q in zip(x, y, strict=False)) for _, y, _ in kept]
        order = sorted((b for b in range(len(kept)) if b != a), key=lambda b: (-score[b], last(kept[b][0]), kept[b][2], b))
        for p in [b for b in order if kept[b][2] == label][:5]:
            fit = [b for b in order if kept[b][2] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:10]
            out += [(anchor, kept[p][0], r + 1, kept[b][0], score[p], score[b]) for r, b in enumerate(fit)]
    return sorted(out, key=str)


def report(spark, rows):
    frame = spark.createDataFrame([(i, v, k, "own", 7) for i, v, k in rows], SCHEMA)
    return sorted((tuple(r) for r in hn.negatives_report(frame).collect()), key=str)


def some_rows(n, dims=64, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.1) for _ in range(dims)] for _ in range(10)]
    return [(i, [rng.gauss(c, 0.12) for c in centres[i % 9]], rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("cells", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, cells):
    if cells:
        monkeypatch.setattr(hn, "ANCHORS", 2)
        monkeypatch.setattr(hn, "ROWS", 100)
    rows = some_rows(801)
    rows += [(None, rows[3][1], 3), (900, rows[4][1], None), (1000, None, 4), (1100, [*rows[5][1][:-1], float("nan")], 5), (1101, [*rows[5][1][:-1], None], 5), (1102, [float("-inf")] * 64, 5)]
    rows += [(1201 + k, rows[0][1], 2) for k in range(300)]  # one vector and label for a quarter of all rows
    rows += [(1600, rows[0][1][:11], 2), (1601, [], 2), (1700, [], 3), (1800, [9e4, -9e4] * 8, 1), (1801, [8e4] * 70, 1), (1802, [5e4] * 70, 6)]
    want = brute_force(rows)
    assert len(want) > 300 and any(r[1] is None or r[3] is None for r in want)
    assert report(spark, rows) == want


def test_repeated_rows_repeat_results(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    # each anchor has the other and row 1 as positives (both of its own score), each of those both copies as negatives
    want = [(100, p, k, 2, 65536, 32768) for p in (100, 1) for k in (1, 2)] * 2
    assert report(spark, rows) == sorted(want, key=str)


def test_no_rows(spark):
    assert report(spark, []) == []
    assert report(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert report(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []  # no positive
    assert report(spark, [(100, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []  # a negative score has no range


def test_tables_of_subsets_give_inner_products():
    rng = np.random.default_rng(4)
    for low, high in ((-5, 6), (-128, 128), (-(1 << 20), 1 << 20), (0, 1), (-1, 0)):
        a, b = rng.integers(low, high, (7, 24)), rng.integers(low, high, (50, 24))
        planes = max(int(x).bit_length() for x in (~b.min(), b.max())) + 1
        assert (hn.looked_up(hn.subset_sums(a), hn.bit_planes(b, planes)) == b @ a.T).all()


def test_negatives_equal_duckdb(spark, sf0001):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf0001}/embeddings.parquet'")
    want = con.sql(hn.ORACLE_SQL)
    got = hn.negatives_report(spark.read.parquet(f"{sf0001}/embeddings.parquet"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
