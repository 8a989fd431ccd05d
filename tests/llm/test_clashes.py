"""Every operator and stage on columns whose names clash with names of their own or hold a dot, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from twigmer.llm import bpe, decontaminate, near_copies, pii, simhash, toxicity
from twigmer.llm._shared import quoted, unused
from twigmer.llm.queries import vocabulary

CLASHES = ["__id", "__key", "__score", "__email", "__text", "__rest", "id", "key", "score", "email", "fp", "rest", "row", "kind", "text_key", "component", "n", "one", "a.b", "x`y"]


@pytest.fixture(scope="module")
def clashing(spark, docs):
    some = docs.where("doc_id is null or doc_id < 20").select("doc_id", "text", "lang", "n_chars")
    return some.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES])


def rows_of(df):
    return sorted((str(r) for r in df.collect()))


def test_names():
    class Frame:
        columns = ["ID", "id_"]

    assert unused(Frame, "id", "id", "key") == ["id__", "id___", "key"]


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "nothing of this kind stands in any of these texts at all")], "item_id long, text string")
    vocab = vocabulary("byte_bpe_50k.json")
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(["good day", "scum"], [0, 1]), out="new"),
        "keep_clean": lambda d: toxicity.keep_clean(d, labels),
        "simhash": lambda d: simhash.keep_one(d),
        "near_copies": lambda d: near_copies.keep_one(d),
        "decontaminate": lambda d: decontaminate.keep_clean(d, items),
        "pii": lambda d: pii.find_pii(d, out="new"),
        "bpe": lambda d: bpe.encode(d, vocab, out="new"),
    }


@pytest.mark.parametrize("name", ["toxicity", "keep_clean", "simhash", "near_copies", "decontaminate", "pii", "bpe"])
def test_other_columns_stay(spark, clashing, name):
    run = operators(spark)[name]
    out = run(clashing)
    assert sorted(c for c in out.columns if c != "new") == sorted(clashing.columns)
    plain = clashing.withColumn("text", F.coalesce("text", F.lit("")))
    before, after = rows_of(plain), rows_of(out.select(*[quoted(c) for c in clashing.columns]).withColumn("text", F.coalesce("text", F.lit(""))))
    if "new" in out.columns:
        assert after == before
    assert set(after) <= set(before) and after
    assert run(clashing.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    tables = {
        "documents": docs.select("doc_id", "text", "lang", F.col("ids").alias("source"), "n_chars"),
        "labels": spark.createDataFrame([(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "foo bar"), (None, None)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() < docs.count()
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    odd = tables["documents"].select("*", *[F.lit(c).alias(c) for c in ("__id", "__pii", "score", "a.b")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, str(tmp_path))
        assert kept.columns == odd.columns, name
        assert {(r["__id"], r["__pii"], r["score"], r["a.b"]) for r in kept.collect()} == {("__id", "__pii", "score", "a.b")}, name


def test_reports_ignore_other_columns(spark, docs):
    """The reports of operators 1 to 3, 5 to 7 and 10 on columns that are named like their own, and on empty tables."""
    from twigmer.llm import balance, media, paragraphs, token_files, warc

    names = ["key", "id", "fp", "text_key", "shard", "slot", "size", "bytes", "node", "line", "kind", "n", "digest", "chunk", "payload", "start", "row", "a.b"]
    plain = docs.where("doc_id is null or doc_id < 40").select("doc_id", "text")
    odd = plain.select("*", *[F.lit(c).alias(c) for c in names])
    reports = {
        "media": media.media_report,
        "tokens": lambda d: token_files.token_report(d, vocabulary("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_crc32"),
        "paragraphs": lambda d: paragraphs.repeated_paragraphs(d).drop("component"),
        "simhash": simhash.simhash_report,
        "shards": lambda d: balance.shard_documents(d).select("doc_id", "size", "text_crc32"),
        "pii": pii.pii_report,
        "warc": lambda d: warc.archive_report(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://e.org/"))).select("page_id", "payload_bytes", "payload_digest", "record_type"),
    }
    for name, report in reports.items():
        assert rows_of(report(odd)) == rows_of(report(plain)), name
        assert report(odd.limit(0)).count() == 0, name
