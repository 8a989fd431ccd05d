"""Building a database from files: alignment, tree, reconstruction -> postings and header."""

from __future__ import annotations

import argparse
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twigmer.operators import alignment as al
from twigmer.operators import compare, database, kmers
from twigmer.operators import tree as tr
from twigmer.plans.settings import BuildParams
from twigmer.sources import reconstruction as ar
from twigmer.sources import storage
from twigmer.sources import text_formats as tf

VERSION = "0.2.0"
TREE_SCHEMA = "label string, parent string, branch_length double, child_ord long, postorder long, preorder long, depth long"


def tree_table(spark: SparkSession, nodes: list[dict]) -> DataFrame:
    """A node table from parsed Newick; nodes without a label are named after their place. Trees are small: they are one text."""
    name = {n["postorder"]: n["label"] or f"#{n['postorder']}" for n in nodes}
    depth: dict = {None: -1}
    for n in sorted(nodes, key=lambda n: n["preorder"]):
        depth[n["postorder"]] = depth[n["parent_pos"]] + 1
    rows = [(name[n["postorder"]], name.get(n["parent_pos"]), n["branch_length"], n["child_ord"], n["postorder"], n["preorder"], depth[n["postorder"]]) for n in nodes]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("labels of the tree repeat")
    return spark.createDataFrame(rows, TREE_SCHEMA)


def ordered(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """Orders and depths for ``(label, parent, branch_length, child_ord)``."""
    return tr.with_orders(tree, depth=True)


def newick(tree: DataFrame) -> str:
    """The text of a tree, from its blocks; what the driver gets is the text that goes into one file or header."""
    if "depth" not in tree.columns:
        tree = tr.with_orders(tree.drop("postorder", "preorder"), depth=True)
    return "".join(r.text for r in tr.newick_blocks(tree).orderBy("block").collect())


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return tree_table(spark, tf.parse_newick(spark.read.text(path, wholetext=True).first()[0]))


def build(
    spark: SparkSession, alignment: str, tree: str, workdir: str, params: BuildParams, ar_dir: str | None = None, ar_binary: str | None = None, ar_config: str | None = None, ar_only: bool = False, threads: int = 1, output: str | None = None, write_reduction: str | None = None
) -> str | None:
    """Build a database and return its path; with ``ar_only``, stop after the reconstruction.

    ``ar_dir`` has the results of an earlier reconstruction; otherwise the tool runs on the driver.
    ``write_reduction``: where the alignment without gap columns goes.
    """
    work = workdir.rstrip("/")
    original = read_tree(spark, tree)
    rooted = tr.is_rooted(original)
    if not rooted and not params.use_unrooted:
        raise ValueError("the tree isn't rooted; use_unrooted accepts it")
    rows = tf.read_fasta(spark, alignment)
    if params.convert_uo and params.states == "amino":
        rows = al.to_canonical_amino(rows)
    al.check_lengths(rows)
    if not params.no_reduction:
        rows = al.drop_gap_columns(rows, params.reduction_ratio)
        al.write_alignment(rows, write_reduction or f"{work}/align.reduced.fasta")
    extended = ordered(spark, tr.extend(original))
    leaves = tr.is_leaf(extended).where("is_leaf").select("label")
    if ar_dir is None:
        known = rows.select("header", "seq_idx")
        wide = al.extend_alignment(rows, leaves).join(known, "header", "left").withColumn("seq_idx", F.coalesce("seq_idx", F.lit(1 << 40) + F.abs(F.xxhash64("header") % F.lit(1 << 40))))
        files = f"{work}/extended_trees"
        al.write_alignment(wide, f"{files}/extended_align.fasta")
        al.write_alignment(wide, f"{files}/extended_align.phylip", "phylip")
        storage.put_text(spark, f"{files}/extended_tree.newick", newick(extended))
        with tempfile.TemporaryDirectory() as local:  # the tool runs on the driver, on files there
            own = [storage.to_driver(spark, f"{files}/{name}", f"{local}/{name}") for name in ("extended_align.phylip", "extended_tree.newick")]
            made = ar.run(ar_binary or ar.find_binary(), *own, params, threads, tf.read_config(ar_config) if ar_config else None)
            probs, ar_tree = (storage.from_driver(spark, path, f"{work}/AR/{Path(path).name}") for path in made)
        tool = "phyml" if "_phyml_" in probs else "raxml-ng"
    else:
        tool, probs, ar_tree = ar.find_outputs(spark, ar_dir)
    if ar_only:
        return None
    reconstructed = read_tree(spark, ar_tree)
    if rooted and not tr.is_rooted(reconstructed):
        reconstructed = ordered(spark, tr.reroot(reconstructed.drop("postorder", "preorder", "depth")))
        storage.put_text(spark, f"{work}/AR/ar_tree_rerooted.newick", newick(reconstructed))
    names = tr.map_nodes(extended, reconstructed)
    ghosts = tr.ghost_mapping(original).where(tr.is_ghost(F.col("label"), params.ghosts))
    wanted = ghosts.join(names, F.col("label") == F.col("ext_label")).join(extended.select("label", F.col("postorder").alias("node_order")), "label")
    if wanted.count() < ghosts.count():
        raise ValueError("ghost nodes are missing from the reconstructed tree")
    matrix = kmers.with_best(tf.READERS[tool](spark, probs, params.states))
    if (lost := wanted.join(matrix.select(F.col("node").alias("ar_label")).distinct(), "ar_label", "left_anti").first()) is not None:
        raise ValueError(f"no probabilities for node {lost.ar_label}")
    matrix = matrix.join(wanted.select(F.col("ar_label").alias("node")), "node", "left_semi")
    branches = wanted.select(F.col("ar_label").alias("node"), F.col("original").cast("int").alias("branch"), "node_order")
    return build_database(matrix, branches, original, params, output or f"{work}/DB")


def build_database(matrix: DataFrame, branches: DataFrame, tree: DataFrame, params: BuildParams, output: str) -> str:
    """Enumerate, keep the best, filter and write. ``tree`` is the original one, with its orders."""
    spark = matrix.sparkSession
    found = kmers.enumerate_kmers(matrix, params.k, params.sigma, params.log_threshold, params.engine)
    best = database.best_per_branch(found, branches, params.keep_positions)
    if params.merge_branches:
        best = database.merged_branches(best).withColumn("branch", F.lit(-1))
    best.write.mode("overwrite").parquet(f"{output}/best")  # read three times below
    best = spark.read.parquet(f"{output}/best")
    filtered = database.FILTERS[params.filter](best, params.threshold, tree.count())
    filtered = database.most_informative(filtered, params.mu)
    if params.mu < 1:
        best = best.join(filtered.select("code"), "code", "left_semi")
    index = tr.tree_index(tree).agg(F.sort_array(F.collect_list(F.struct("postorder", "num_nodes", "subtree_length"))).alias("tree_index"))
    header = database.counts(best).join(index).select(
        F.lit(params.states).alias("sequence_type"), "tree_index", F.lit(newick(tree)).alias("tree"), F.lit(params.k).alias("k"), F.lit(params.omega).alias("omega"), "num_kmers", "num_entries"
    )
    database.write_database(output, best, filtered, header, "uncompressed" if params.uncompressed else "zstd")
    return output


def dump_database(spark: SparkSession, path: str) -> DataFrame:
    """``(kmer, branch, score)`` with preorder ids, from a database on disk."""
    rows, header = database.read_database(spark, path)
    h = header.first()
    tree = tree_table(spark, tf.parse_newick(h.tree))
    alphabet = BuildParams(states=h.sequence_type, k=h.k, omega=h.omega).alphabet
    return compare.dump(database.flat(rows), tree, h.k, alphabet)


def diff_databases(spark: SparkSession, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Differences of headers, and of entries."""
    (rows_a, header_a), (rows_b, header_b) = database.read_database(spark, a), database.read_database(spark, b)
    return compare.header_diff(header_a, header_b), compare.database_diff(database.flat(rows_a), database.flat(rows_b))


def main(argv: list[str] | None = None) -> int:
    """``python -m twigmer build|dump|diff|diff-text ...``; differences make a non-zero exit status."""
    p = argparse.ArgumentParser(prog="twigmer")
    p.add_argument("--version", action="version", version=f"twigmer {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    for name in ("refalign", "reftree", "workdir"):
        b.add_argument(f"-{ {'refalign': 'r', 'reftree': 't', 'workdir': 'w'}[name]}", f"--{name}", required=True)
    b.add_argument("-s", "--states", default="nucl")
    b.add_argument("-k", type=int, default=8)
    b.add_argument("--omega", type=float, default=1.5)
    b.add_argument("-u", "--mu", type=float, default=1.0)
    b.add_argument("--reduction-ratio", type=float, default=0.99)
    b.add_argument("--filter", default="mif0")
    b.add_argument("--ghosts", default="both")
    b.add_argument("--engine", default="numpy")
    b.add_argument("-m", "--model")
    b.add_argument("-a", "--alpha", type=float, default=1.0)
    b.add_argument("-c", "--categories", type=int, default=4)
    b.add_argument("--threads", type=int, default=1)
    for name in ("ar", "ar-dir", "ar-config"):
        b.add_argument(f"--{name}")
    b.add_argument("-o", "--output")
    b.add_argument("--write-reduction")
    b.add_argument("-v", "--verbosity", type=int, default=1, help="above 1, Spark's own messages are shown")
    for flag in ("no-reduction", "use-unrooted", "merge-branches", "keep-positions", "ar-only", "convert-uo", "uncompressed"):
        b.add_argument(f"--{flag}", action="store_true")
    b.add_argument("--on-disk", action="store_true", help="accepted; Spark spills by itself")
    sub.add_parser("dump").add_argument("database")
    d = sub.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    d.add_argument("-v", "--verbose", action="store_true")
    t = sub.add_parser("diff-text")
    t.add_argument("a")
    t.add_argument("b")
    t.add_argument("--threshold", type=float, default=0.0, help="scores near it are left out, as are scores near each other")
    t.add_argument("--tolerance", type=float, default=compare.TEXT_TOLERANCE)
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("twigmer").getOrCreate()
    if o.command == "build":
        params = BuildParams(
            o.states, o.k, o.omega, o.reduction_ratio, o.no_reduction, o.ghosts, o.use_unrooted, o.merge_branches, o.keep_positions, o.filter, o.mu, o.engine, o.model, o.alpha, o.categories, o.convert_uo, o.uncompressed
        )
        spark.sparkContext.setLogLevel("INFO" if o.verbosity > 1 else "WARN")
        print(build(spark, o.refalign, o.reftree, o.workdir, params, o.ar_dir, o.ar, o.ar_config, o.ar_only, o.threads, o.output, o.write_reduction) or "reconstruction done")
        return 0
    if o.command == "dump":
        for r in compare.dump_text(dump_database(spark, o.database)).toLocalIterator():
            print(r.value)
        return 0
    if o.command == "diff-text":
        rows, bad = compare.text_diff(tf.read_dump(spark, o.a), tf.read_dump(spark, o.b), o.threshold, o.tolerance), 0
        for r in rows.orderBy("kmer", "branch").toLocalIterator():
            print(r.kmer, r.branch, r.score_a, r.score_b, sep="\t")
            bad += 1
        return int(bad > 0)
    head, rows = diff_databases(spark, o.a, o.b)
    bad = 0
    for r in head.orderBy("field").collect():
        print(f"{'OK' if r.same else 'DIFF'} {r.field}")
        bad += not r.same
    n = rows.count()
    print(f"{'DIFF' if n else 'OK'} entries: {n}")
    if o.verbose:
        for r in rows.toLocalIterator():
            print(r.code, r.branch, r.score_a, r.score_b, r.kind, sep="\t")
    return int(bool(bad or n))
