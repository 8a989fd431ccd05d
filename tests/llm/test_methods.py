"""That the dealt methods themselves are at work: differencing across blocks, trees over leaves, runs of archives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twigmer.llm import balance, bpe, warc
from twigmer.llm.queries import vocabulary


def test_blocks_are_levelled_as_if_all_groups_were_differenced_at_once(spark, monkeypatch):
    rng = random.Random(31)
    sizes = [int(rng.lognormvariate(7, 1.2)) + 16 for _ in range(6000)] + [400_000, 150_000, 90_000]
    groups = spark.createDataFrame([(str(i).encode(), s) for i, s in enumerate(sizes)], "key binary, bytes long")
    whole = balance.difference([np.r_[s, np.zeros(39, np.int64)] for s in sizes])[0]
    monkeypatch.setattr(balance, "BLOCK_GROUPS", 700)
    rows = balance.shard_groups(groups, 40).join(groups, "key").groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in rows) == len(sizes) and {r.shard for r in rows} <= set(range(40))
    free = [r.b for r in rows if r.n > 1]  # a group above the mean has a shard to itself
    assert max(free) - min(free) <= int(whole[0] - whole[-1]) + 8 or max(whole) == 400_000 and max(free) - min(free) <= 8


def test_long_texts_take_the_tree_and_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(32)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    word = lambda: rng.choice(["alpha", "ß", "日本語", "don't", "12345", "  ", "\n\n", "x" * rng.randint(1, 30), "!?", "é"])
    texts = ["".join(word() + rng.choice([" ", ""]) for _ in range(6000)) for _ in range(4)]
    texts += ["a" * 70_000, "<|endoftext|>".join(t[:9000] for t in texts), "<|endof" * 6000, " " * 40_000, texts[0], "<|endoftext|>" * 3000]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert min(map(len, texts)) > 2 * bpe.LEAF_CHARS  # all of them are cut
    got = bpe.encode(docs, vocabulary("byte_bpe_50k.json")).collect()
    want = {t: library.encode(t, add_special_tokens=False).ids for t in texts}
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i % 9, t) for i, t in enumerate(texts))
    assert all(r.ids == want[r.text] for r in got)


def test_leaves_take_ids_and_their_row_along(spark):
    """Texts aren't dealt out again with their ids, nor joined with their rows, whose columns of any type stay."""
    texts = ["word next é " * 3000, "<|endoftext|>".join(["ab 12 " * 900] * 6), "short", None, "word next é " * 3000]
    docs = spark.createDataFrame([(i if i % 3 else None, t, {"k": i} if i % 2 else None, [(i, None)], None) for i, t in enumerate(texts)], "doc_id long, text string, m map<string,int>, a array<struct<x:int,y:string>>, z binary")
    made = bpe.encode(docs, vocabulary("byte_bpe_50k.json"))
    assert sorted(str((r.doc_id, r.text, r.m, r.a, r.z)) for r in made.collect()) == sorted(str((r.doc_id, r.text or "", r.m, r.a, r.z)) for r in docs.collect())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    report = bpe.roundtrip(docs, vocabulary("byte_bpe_50k.json"))._jdf.queryExecution().optimizedPlan().toString()
    assert report.count("MapInArrow") == 4  # short texts take one Python worker, not one to encode and one to decode
    assert "Join" not in plan and not [x for x in plan.split("\n") if "collect_list" in x and "part#" in x]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_archives_are_in_utc_in_any_session(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        pages = spark.createDataFrame([(i, f"http://e.org/{i % 3}", f"page {i % 4}") for i in range(12)], "page_id long, url string, html string")
        got = sorted(warc.archive_report(pages).collect(), key=lambda r: r.page_id)
        assert [r.captured for r in got] == [1_700_000_000 + i for i in range(12)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_runs_merge_in_passes():
    rng = random.Random(33)
    runs = [sorted((rng.randrange(1000), k, i) for i in range(rng.randint(0, 9))) for k in range(300)]
    want = sorted(x for r in runs for x in r)
    for fan_in in (2, 7, 256):
        assert [x[0] for x in warc.merged_runs([iter(r) for r in runs], fan_in)] == [x[0] for x in want]


def test_long_pages_get_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 16_000)
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", "x" * (5000 if i % 5 == 0 else 20) + str(i)) for i in range(40)], "page_id long, url string, html string")
    got = warc.archive_report(pages).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(i, (5000 if i % 5 == 0 else 20) + len(str(i)), "response") for i in range(40)]
