"""Domain inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twigmer.operators import kmers

K, OMEGA, OMEGA_B = 4, 1.37, 1.45
#: Width of the alignment whose rows are the blocks of all documents.
WIDTH = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, sigma: int = 4) -> DataFrame:
    """``(node, site, state, p)``: suppliers as nodes, parts dealt over 24 sites, states by order and line."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long")
    counted = li.groupBy(
        F.col("l_suppkey").alias("node"), (F.col("l_partkey") % 24).cast("int").alias("site"), ((F.col("l_orderkey") + n * n) % sigma).cast("int").alias("state")
    ).agg(F.count(F.lit(1)).alias("c"))
    totals = counted.groupBy("node", "site").agg(F.sum("c").alias("t"))
    return counted.join(totals, ["node", "site"]).select("node", "site", "state", (F.col("c") / F.col("t")).alias("p"))


def matrix(spark: SparkSession, sf_dir: str, sigma: int = 4) -> DataFrame:
    return kmers.pack(cells(spark, sf_dir, sigma), sigma)


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, branch, node_order)``: suppliers are the ghosts of their nation."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("int").alias("branch"), F.col("s_suppkey").alias("node_order"))


def nation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, parent, branch_length, child_ord)``: a root, regions, nations."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = spark.createDataFrame([("root", None, 0.0, 0)], "label string, parent string, branch_length double, child_ord long")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = r.select(name("R", "r_regionkey").alias("label"), F.lit("root").alias("parent"), (F.lit(0.1) * (F.col("r_regionkey") + 1)).alias("branch_length"), F.col("r_regionkey").cast("long").alias("child_ord"))
    nations = n.select(name("N", "n_nationkey").alias("label"), name("R", "n_regionkey").alias("parent"), (F.lit(0.05) * (F.col("n_nationkey") % 7 + 1)).alias("branch_length"), F.col("n_nationkey").cast("long").alias("child_ord"))
    return root.unionByName(regions).unionByName(nations)


def supplier_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation tree with suppliers as leaves."""
    s = table(spark, sf_dir, "supplier")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    leaves = s.select(name("S", "s_suppkey").alias("label"), name("N", "s_nationkey").alias("parent"), F.round(F.abs("s_acctbal") / 10000, 4).alias("branch_length"), F.col("s_suppkey").cast("long").alias("child_ord"))
    return nation_tree(spark, sf_dir).unionByName(leaves)


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq_idx, header, seq)``: whole documents in rows of 60 characters, the last filled up with gaps, letters other than ACGT as gaps.

    A document without text has one row of gaps. ``seq_idx`` is the document's id times 2^32 and the row's place in it.
    """
    rows = document_rows(spark, sf_dir)
    letters = F.regexp_replace(F.translate("seq", "acgt", "ACGT"), "(?s)[^ACGT]", "-")
    return rows.withColumn("seq", F.rpad(letters, WIDTH, "-"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq_idx, header, seq)``: whole documents in rows of 60 characters, as they are."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    parts = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0)))
    rows = d.select("doc_id", F.posexplode(parts).alias("at", "part"))
    header = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("_"), F.col("at").cast("string"))
    return rows.select((F.col("doc_id") * (1 << 32) + F.col("at")).alias("seq_idx"), header.alias("header"), F.col("part").alias("seq"))
