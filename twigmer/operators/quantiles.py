"""Exact quantiles of groups of any size: order statistics by ranges, no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigmer.operators.database import ranked


def hazen_quantiles(rows: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """``(*by, n, quantile)``: the value at place n * p - 1/2 of each group's order, linear between neighbours; null values don't count.

    Rows are ranged by group and value and counted by range, so that a group of any size is spread over tasks. Of each
    group only the two ranks around the place are fetched.
    """
    r = ranked(rows.select(*by, F.col(value).cast("double").alias("__value")).where("__value is not null"), *by, "__value")
    sizes = r.groupBy(*by).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 0")
    at = F.greatest(F.lit(0.0), F.least(F.col("n") * F.lit(p) - F.lit(0.5), (F.col("n") - 1).cast("double")))
    low = F.floor(at)
    ranks = F.array(F.struct((F.col("first") + low).alias("rank"), F.lit(0).alias("side")), F.struct((F.col("first") + F.least(low + 1, F.col("n") - 1)).alias("rank"), F.lit(1).alias("side")))
    wanted = sizes.select(*by, "n", (at - low).alias("part"), F.inline(ranks))
    found = wanted.join(r.select("rank", "__value"), "rank").groupBy(*by, "n", "part")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("__value")))
    ends = found.agg(side(0).alias("a"), side(1).alias("b"))
    return ends.select(*by, "n", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
