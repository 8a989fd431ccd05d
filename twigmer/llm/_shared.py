"""Helpers shared by the operators of this subpackage: tables, shared scratch space, components."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables below this size may be dealt out anew.
SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than the session has cores is dealt out to as many tasks."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES
    return df.repartition(tasks) if small and 0 < len(df.inputFiles()) < tasks else df


def quoted(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names no such folder and runs on one machine is a local one set; a cluster without one raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in shared scratch space and read it back: lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, even where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges(a, b)`` hold comparable ids of one type. Returns ``(id, root)`` for every id that
    occurs in an edge, ``root`` being the smallest id of its component. Neighbourhoods are never
    gathered: each round takes per-node minima (combined map-side) and joins them back, so that a
    node with very many neighbours stays a splittable join. Every round is written to shared
    storage; the loop ends when a round changes no edge.
    """

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    def changed(new: DataFrame, old: DataFrame) -> bool:
        both = [
            x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            for x in (new, old)
        ]
        return tuple(both[0]) != tuple(both[1])

    star = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node moves to the smallest id around that node
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = minima(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node, move to the smallest of them
        low = minima(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        done = not changed(new, star)
        star = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = star.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    return star.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
