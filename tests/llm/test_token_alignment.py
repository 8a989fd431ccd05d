"""Alignment of two tokenizers against brute force over odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from twigmer.llm import token_alignment as ta
from twigmer.llm.queries import vocabulary

FILES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def spans(pieces):
    out, at = [], 0
    for token, data in pieces:
        out.append((token, at, at + len(data)))
        at += len(data)
    return out


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(libraries, text):
    """Spans of both tokenizers by their libraries, or none."""
    a, b = libraries
    if not text:
        return [], []
    to_byte = byte_of()
    left = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    right = [(i, piece(b.id_to_piece(i))) for i in b.encode(text)]
    if any(b"".join(d for _, d in x) != b" " + text.encode() for x in (left, right)):
        return [], []
    return spans(left), spans(right)


def brute_force(libraries, texts):
    made, held = [], Counter()
    for text in texts:
        a, b = tokens(libraries, text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) < 400 else fast_links(a, b)
        held.update(set(links))
        made.append((a, b, links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    for a, b, links in made:
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        group = lambda side, s, e: ",".join(str(i) for i, p, q in side if s <= p and q <= e)
        groups = ";".join(f"{group(a, s, e)}|{group(b, s, e)}" for s, e in zip([0, *ends], ends, strict=False))
        sha = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        yield len(a), len(b), len(ends), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha


def fast_links(a, b):
    """Of tokens that follow one another, those that overlap."""
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("pairs", "parts"), [(1 << 21, 500_000), (40, 60)])
def test_alignment_of_odd_rows(spark, docs, libraries, monkeypatch, pairs, parts):
    monkeypatch.setattr(ta, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(ta, "PARTS", parts)  # what is remembered is forgotten often
    monkeypatch.setattr(ta, "SLICE_CHARS", parts * 1000)
    rng = random.Random(8)
    odd = [*ODD, "▁ a ▁b", "<s> </s> <unk> <0x41> <pad>", "\u0000\u0001 x", "é ﬁ 　 Ａ", "\U0001f600\U0001f601 \U0001f1e9\U0001f1ea", "x" * 3000, "﻿bom", "a​b­c", "\r\n\r\n \t", " lead", "trail ", "�"]
    odd += ["".join(rng.choice(["a", "b", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "'s", "1", "é", "\u0301", "日", ".", "\u200b"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    odd += ["".join(rng.choice("ab é日.,'\n0<|_▁") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).repartition(3)
    rows = more.collect()
    want = sorted(str((r.doc_id, *x)) for r, x in zip(rows, brute_force(libraries, [r.text for r in rows]), strict=True))
    frame = spark.createDataFrame([(*r, 1, [2], "own", 3) for r in rows], "doc_id long, text string, block long, a array<int>, rest string, pairs int").repartition(3)
    got = ta.alignment_report(frame, *FILES)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert any("'')" in w for w in want)
    assert ta.alignment_report(frame.limit(0), *FILES).count() == 0


def test_groups_keep_other_columns(spark):
    frame = spark.createDataFrame([("hello world", 1, "z"), (None, 2, None)], "text string, `a.b` int, rest string")
    one, two = sorted(ta.align(frame, *FILES).collect(), key=lambda r: r["a.b"])
    assert (one.rest, two.rest, two.a_ids, two.b_ends) == ("z", None, [], [])
    assert one.a_ends[-1] == len(one.a_ids) and one.b_ends[-1] == len(one.b_ids) and len(one.a_ends) == len(one.b_ends)


def test_links_are_those_that_overlap():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        a, b = (np.union1d(rng.choice(n, int(rng.integers(0, n + 1)), replace=False) + 1, [n]) for _ in range(2))
        cuts = ta.group_ends(a, b)
        starts = np.r_[0, a[:-1]], np.r_[0, b[:-1]]
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]}
        got = list(zip(*(x.tolist() for x in ta.expand_links(a, b, *cuts)), strict=True))
        assert len(got) == len(want) and set(got) == want
