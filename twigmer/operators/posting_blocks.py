"""Postings in blocks: a k-mer's branches by ranges of branch ids, so that no row grows with the number of branches; lookups by k-mer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Branch ids that a block covers, hence its most entries.
BLOCK = 1024
#: Codes that a lookup may push down one by one; more are joined.
PUSHED = 1000
#: Bytes of a row group of a table for lookups: small, so that a lookup reads little more than it returns.
GROUP_BYTES = 1 << 20


def posting_blocks(best: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(code, block, first, n, best, steps, scores)`` of ``best(branch, code, score)``.

    A block has the entries of ``size`` consecutive branch ids, in order: the first branch, how far each lies behind it,
    their scores and the best of them. A k-mer's blocks are grouped apart: one that all branches have is no hot group.
    """
    at = F.floor(F.col("branch") / size).cast("long").alias("block")
    made = best.groupBy("code", at).agg(F.sort_array(F.collect_list(F.struct("branch", "score"))).alias("e"), F.max("score").alias("best"))  # size at most
    first = F.col("e")[0]["branch"]
    steps = F.transform("e", lambda x: (x["branch"] - first).cast("int"))
    return made.select("code", "block", first.alias("first"), F.size("e").alias("n"), "best", steps.alias("steps"), F.transform("e", lambda x: x["score"]).alias("scores"))


def entries(blocks: DataFrame) -> DataFrame:
    """``(code, branch, score)`` of the blocks."""
    rows = blocks.select("code", "first", F.inline(F.arrays_zip("steps", "scores")))
    return rows.select("code", (F.col("first") + F.col("steps")).alias("branch"), F.col("scores").alias("score"))


def above(blocks: DataFrame, score: float) -> DataFrame:
    """The entries above a score; blocks whose best isn't above it are left out by their statistics."""
    return entries(blocks.where(F.col("best") > score)).where(F.col("score") > score)


def write_by_code(path: str, best: DataFrame, size: int = BLOCK, group_bytes: int = GROUP_BYTES) -> None:
    """Blocks in ranges of codes, sorted by code, in small row groups with Bloom filters and page indexes on it."""
    rows = posting_blocks(best, size).repartitionByRange("code").sortWithinPartitions("code", "block")
    rows.write.option("parquet.bloom.filter.enabled#code", "true").option("parquet.block.size", group_bytes).option("parquet.page.size", group_bytes // 16).option("compression", "zstd").parquet(path)


def lookup(spark: SparkSession, path: str, codes: Iterable[int] | DataFrame) -> DataFrame:
    """The blocks of these codes: a list is pushed down to the files code by code, a table ``(code)`` of any size is joined."""
    rows = spark.read.parquet(path)
    if isinstance(codes, DataFrame):
        return rows.join(codes.select("code").distinct(), "code", "left_semi")
    wanted = sorted(set(codes))
    if len(wanted) > PUSHED:
        raise ValueError(f"more than {PUSHED} codes; pass a table")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PUSHED))
    return rows.where(F.col("code").isin(wanted))
