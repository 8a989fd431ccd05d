"""Dumping databases and comparing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigmer.functions.scoring import decode, linear

SCORE_TOLERANCE = 1e-2
TEXT_TOLERANCE = 1e-3


def dump(best: DataFrame, tree: DataFrame, k: int, alphabet: str) -> DataFrame:
    """``(kmer, branch, score)``: letters, preorder id of the branch, probability. ``tree(postorder, preorder)``."""
    rows = best.join(tree.select(F.col("postorder").alias("branch"), "preorder"), "branch")
    return rows.select(decode(F.col("code"), k, alphabet).alias("kmer"), F.col("preorder").alias("branch"), linear(F.col("score")).alias("score"))


def dump_text(rows: DataFrame) -> DataFrame:
    """The dump as text, one k-mer with its lines in each row: the k-mer, then TAB score TAB branch."""
    line = F.concat(F.lit("\t"), F.col("score").cast("string"), F.lit("\t"), F.col("branch").cast("string"))
    lines = rows.groupBy("kmer").agg(F.sort_array(F.collect_list(F.struct("branch", line.alias("line")))).alias("l"))
    return lines.select(F.concat_ws("\n", F.col("kmer"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))


def database_diff(a: DataFrame, b: DataFrame, tolerance: float = SCORE_TOLERANCE) -> DataFrame:
    """``(code, branch, score_a, score_b, kind)`` of the entries that only one has or whose scores differ."""
    both = a.select("code", "branch", F.col("score").alias("score_a")).join(b.select("code", "branch", F.col("score").alias("score_b")), ["code", "branch"], "full_outer")
    kind = F.when(F.col("score_b").isNull(), "only_a").when(F.col("score_a").isNull(), "only_b").otherwise("score")
    differs = F.col("score_a").isNull() | F.col("score_b").isNull() | (F.abs(F.col("score_a") - F.col("score_b")) >= tolerance)
    return both.where(differs).withColumn("kind", kind)


def header_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(field, a, b, same)`` for every field of two one-row headers."""

    def fields(h: DataFrame, name: str) -> DataFrame:
        return h.select(F.explode(F.create_map(*[x for c in h.columns for x in (F.lit(c), F.to_json(F.struct(c)))])).alias("field", name))

    return fields(a, "a").join(fields(b, "b"), "field", "full_outer").withColumn("same", F.col("a").eqNullSafe(F.col("b")))


def difference_report(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], tolerance: float = SCORE_TOLERANCE) -> DataFrame:
    """``(field, a, b, same)``, one row a check, of two databases (postings, header) as :func:`.database.read_database` gives them.

    The fields of the headers as they are stored (``tree``: whether the texts are equal), how many k-mers and entries there are in fact, how many entries only one has, and how many
    scores differ. All of what concerns entries is counted in one pass over their full join, by partial aggregation.
    """
    (rows_a, header_a), (rows_b, header_b) = a, b
    shown = lambda h, c: F.lit("") if c == "tree" else F.col(c).cast("string") if c in h.columns else F.lit(None).cast("string")
    fields = [c for c in dict.fromkeys([*header_a.columns, *header_b.columns]) if c not in ("num_kmers", "num_entries", "tree_index")]
    structs = lambda h: F.array(*[F.struct(F.lit(c).alias("field"), shown(h, c).alias("shown"), (F.md5(F.col(c).cast("string")) if c in h.columns else F.lit(None).cast("string")).alias("key")) for c in fields])
    heads = [h.select(F.inline(structs(h))) for h in (header_a, header_b)]
    known = heads[0].select("field", F.col("shown").alias("a"), F.col("key").alias("key_a")).join(heads[1].select("field", F.col("shown").alias("b"), F.col("key").alias("key_b")), "field")
    known = known.select("field", "a", "b", F.col("key_a").eqNullSafe(F.col("key_b")).alias("same"))

    # a k-mer's row in each database says once that it is there; its entries are matched by branch
    side = lambda rows, name: rows.select("code", F.posexplode("entries").alias("at", "e")).select("code", F.col("e.branch").alias("branch"), F.col("e.score").alias(name), (F.col("at") == 0).cast("long").alias(f"kmer_{name}"))
    both = side(rows_a, "a").join(side(rows_b, "b"), ["code", "branch"], "full_outer")
    moved = F.count_if(F.abs(F.col("a") - F.col("b")) >= tolerance)
    n = both.agg(
        F.coalesce(F.sum("kmer_a"), F.lit(0)).alias("kmers_a"), F.coalesce(F.sum("kmer_b"), F.lit(0)).alias("kmers_b"), F.count("a").alias("entries_a"), F.count("b").alias("entries_b"),
        F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), moved.alias("moved"),
    )
    check = lambda field, x, y, same: F.struct(F.lit(field).alias("field"), x.cast("string").alias("a"), y.cast("string").alias("b"), same.alias("same"))
    equal = lambda field, x, y: check(field, F.col(x), F.col(y), F.col(x) == F.col(y))
    counted = F.array(
        equal("num_kmers", "kmers_a", "kmers_b"), equal("num_entries", "entries_a", "entries_b"),
        check("entries_of_one", F.col("only_a"), F.col("only_b"), (F.col("only_a") == 0) & (F.col("only_b") == 0)), check("scores", F.col("moved"), F.col("moved"), F.col("moved") == 0),
    )
    return known.unionByName(n.select(F.inline(counted)))


def text_diff(a: DataFrame, b: DataFrame, threshold: float, tolerance: float = TEXT_TOLERANCE) -> DataFrame:
    """``(kmer, branch, score_a, score_b)`` of two dumps, but for scores near each other or near the threshold.

    A score of zero counts as missing. K-mers that only the second dump has aren't reported.
    """
    both = a.select("kmer", "branch", F.col("score").alias("score_a")).join(b.select("kmer", "branch", F.col("score").alias("score_b")), ["kmer", "branch"], "full_outer")
    both = both.join(a.select("kmer").distinct(), "kmer", "left_semi")
    x, y = (F.when(F.col(c) != 0, F.col(c)) for c in ("score_a", "score_b"))
    near = lambda u, v: F.coalesce(F.abs(u - v) < tolerance, F.lit(False))
    ignored = near(x, F.lit(threshold)) | near(y, F.lit(threshold)) | near(x, y) | (x.isNull() & y.isNull())
    return both.where(~ignored)
