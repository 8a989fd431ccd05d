"""From k-mers of nodes to a scored inverted index: best scores, postings, filter values, order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twigmer.functions.scoring import clamped, entropy_term, uniform
from twigmer.sources.shared import shared_folder


def best_per_branch(kmers: DataFrame, branches: DataFrame, positions: bool = False) -> DataFrame:
    """``(branch, code, score[, position])``: the best score of each k-mer over the nodes of a branch.

    ``branches(node, branch, node_order)``. With positions, that of the best score; of equal scores,
    of the first node in order, then the first position.
    """
    rows = kmers.join(branches, "node").groupBy("branch", "code")
    if not positions:
        return rows.agg(F.max("score").alias("score"))
    first = F.struct("score", -F.col("node_order"), -F.col("position"))
    return rows.agg(F.max("score").alias("score"), F.max_by("position", first).alias("position"))


def merged_branches(best: DataFrame) -> DataFrame:
    """One best score per k-mer over all branches."""
    return best.groupBy("code").agg(F.max("score").alias("score"))


def postings(best: DataFrame) -> DataFrame:
    """``(code, entries)``: the branches of each k-mer with their scores, in branch order."""
    fields = [c for c in ("branch", "score", "position") if c in best.columns]
    return best.groupBy("code").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entries"))


def counts(best: DataFrame) -> DataFrame:
    return best.agg(F.count_distinct("code").alias("num_kmers"), F.count(F.lit(1)).alias("num_entries"))


def score_sums(best: DataFrame, threshold: float, n_nodes: int) -> DataFrame:
    """Per k-mer: entries ``n``, their sum and entropy terms, and ``total`` with the branches that lack it at the threshold."""
    x = clamped(F.col("score"))
    made = best.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("stored"), F.sum(entropy_term(x)).alias("terms"))
    return made.withColumn("total", F.col("stored") + (F.lit(n_nodes) - F.col("n")) * F.lit(threshold))


def mif0(best: DataFrame, threshold: float, n_nodes: int, entries: str | None = None) -> DataFrame:
    """``(code, filter_value)``: total score times (entropy over branches - log2 of their number); small is informative.

    ``entries``: the name of a further column with the number of a k-mer's entries, from the same aggregation.
    """
    s = score_sums(best, threshold, n_nodes)
    h = (F.col("terms") + F.col("stored") * F.log2("total")) / F.col("total")
    h = h + (F.lit(n_nodes) - F.col("n")) * entropy_term(F.lit(threshold) / F.col("total"))
    return s.select("code", (F.col("total") * (h - F.lit(math.log2(n_nodes)))).alias("filter_value"), *([F.col("n").alias(entries)] if entries else []))


def random_filter(best: DataFrame, threshold: float = 0.0, n_nodes: int = 0, seed: int = 42) -> DataFrame:
    """``(code, filter_value)``: a repeatable uniform number for each k-mer."""
    return best.select("code").distinct().select("code", uniform(F.col("code"), seed).alias("filter_value"))


FILTERS = {"mif0": mif0, "random": random_filter}


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Add ``rank`` (from 0) in the global order of columns: ranges are numbered apart and shifted by what precedes them."""
    from pyspark.sql import Window

    shared_folder(df.sparkSession)
    place = F.monotonically_increasing_id()  # the partition's number in the high bits, the row's in the low 33
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place).checkpoint()
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("before"))  # a row for each partition
    out = ordered.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn("rank", F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "before")


def most_informative(filtered: DataFrame, mu: float) -> DataFrame:
    """The first ceil(mu * n) k-mers by filter value, then code."""
    if mu >= 1:
        return filtered
    r = ranked(filtered, "filter_value", "code")
    return r.where(F.col("rank") < math.ceil(mu * r.count())).drop("rank")


def write_database(path: str, best: DataFrame, filtered: DataFrame, header: DataFrame, codec: str = "zstd") -> None:
    """Postings with filter values, in files ranged and sorted by filter value, and a one-row header."""
    rows = postings(best).join(filtered, "code")
    order = ["filter_value", "code"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", codec).parquet(f"{path}/postings")
    header.coalesce(1).write.parquet(f"{path}/header")


def read_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nested postings and the header."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/header")


def flat(postings_: DataFrame) -> DataFrame:
    return postings_.select("code", "filter_value", F.explode("entries").alias("e")).select("code", "filter_value", "e.*")
