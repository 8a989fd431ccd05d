"""Rooted trees as node tables, and their extension by ghost nodes.

A tree is ``(label, parent, branch_length double, postorder long, preorder long)``; labels are
unique, the root has no parent. Orders count from 0. A column ``child_ord`` gives the order of
children where a tree is built; the orders stand for it afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twigmer.operators.database import ranked
from twigmer.sources.shared import shared_folder

GHOST_SUFFIXES = ("_X0", "_X1", "_X2", "_X3")
GHOST_LEAF_LENGTH = 0.01
#: Rows whose running sums are taken in one group.
BLOCK = 4096


def stored(df: DataFrame) -> DataFrame:
    """A round's result, kept in the shared folder: the next round reads it instead of running all earlier ones again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rounds(nodes: DataFrame) -> int:
    """Rounds of doubling after which all paths have ended, unless the parents run in a circle."""
    return nodes.count().bit_length() + 1


def path_sums(steps: DataFrame) -> DataFrame:
    """Sums of the columns after ``(label, up)`` over each node and its ancestors.

    Each round doubles how far a node sees, so there are as many as the depth has bits, each over one row a node.
    """
    names = [c for c in steps.columns if c not in ("label", "up")]
    steps = stored(steps)
    for _ in range(rounds(steps)):
        live = steps.where("up is not null")
        if live.isEmpty():
            return steps.drop("up")
        above = steps.select(F.col("label").alias("up"), F.col("up").alias("far"), *[F.col(c).alias(f"more_{c}") for c in names])
        seen = live.join(above, "up", "left").select("label", F.col("far").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in names])
        steps = stored(seen.unionByName(steps.where("up is null")))
    raise ValueError("the parents of the tree run in a circle")


def is_leaf(tree: DataFrame) -> DataFrame:
    inner = tree.select(F.col("parent").alias("label")).where("label is not null").distinct().withColumn("inner", F.lit(True))
    return tree.join(inner, "label", "left").withColumn("is_leaf", F.col("inner").isNull()).drop("inner")


def subtree_stats(tree: DataFrame) -> DataFrame:
    """Per node: ``n_leaves, n_nodes`` (itself included), ``subtree_length`` (branches under it) and
    ``leaf_distance`` (sum of the distances to its leaves; zero for a leaf).

    After i rounds a row holds the sums over descendants less than 2^i steps away; those that the node's descendants
    2^i steps away hold are added. As many rounds as the depth has bits, each over one row a node.
    """
    long = lambda c: c.cast("long")
    length = F.coalesce("branch_length", F.lit(0.0))
    own = is_leaf(tree).select("label", "parent", length.alias("own"), "is_leaf")
    sums = own.select(
        "label", F.col("parent").alias("up"), F.col("own").alias("away"), "own", F.col("own").alias("length"), long(F.lit(1)).alias("n_nodes"), long(F.col("is_leaf")).alias("n_leaves"), F.lit(0.0).alias("leaf_distance")
    )
    sums = stored(sums)
    for _ in range(rounds(sums)):
        live = sums.where("up is not null")
        if live.isEmpty():
            return sums.select("label", "n_leaves", "n_nodes", (F.col("length") - F.col("own")).alias("subtree_length"), "leaf_distance")
        reached = F.col("leaf_distance") + F.col("n_leaves") * F.col("away")
        added = live.groupBy(F.col("up").alias("label")).agg(F.sum("length").alias("a_length"), F.sum("n_nodes").alias("a_n_nodes"), F.sum("n_leaves").alias("a_n_leaves"), F.sum(reached).alias("a_leaf_distance"))
        above = sums.select(F.col("label").alias("up"), F.col("up").alias("far"), F.col("away").alias("more"))
        both = sums.join(added, "label", "left").join(above, "up", "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"a_{c}", F.lit(0))).alias(c)
        sums = stored(both.select("label", F.col("far").alias("up"), (F.col("away") + F.coalesce("more", F.lit(0.0))).alias("away"), "own", *[plus(c) for c in ("length", "n_nodes", "n_leaves", "leaf_distance")]))
    raise ValueError("the parents of the tree run in a circle")


def running_sums(rows: DataFrame, column: str) -> DataFrame:
    """Add ``before``: the column's sum over all rows of smaller ``rank``. Blocks of ranks are summed apart, then shifted."""
    rows = rows.withColumn("block", F.floor(F.col("rank") / BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK rows
    shift = rows.groupBy("block").agg(F.sum(column).alias("t")).select("block", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("before", F.coalesce(F.sum(column).over(inside), F.lit(0))).join(shift, "block")
    return summed.withColumn("before", F.col("before") + F.col("shift")).drop("block", "shift")


def ghost_lengths(tree: DataFrame) -> DataFrame:
    """Per non-root node: lengths of the branch up to its ghost X0, of X1, and what is left of its own."""
    rows = is_leaf(tree).where("parent is not null").join(subtree_stats(tree), "label")
    half = F.col("branch_length") / 2
    rest = F.col("branch_length") - half
    x1 = F.when(F.col("is_leaf"), half).otherwise((F.col("leaf_distance") + rest * F.col("n_leaves")) / F.col("n_leaves"))
    return rows.select("label", "parent", "postorder", half.alias("x0_length"), x1.alias("x1_length"), rest.alias("own_length"))


def _ghost(n_nodes: int, i: int):
    return F.concat((F.lit(n_nodes + 1 + i) + 4 * F.col("postorder")).cast("string"), F.lit(GHOST_SUFFIXES[i]))


def extend(tree: DataFrame) -> DataFrame:
    """``(label, parent, branch_length, child_ord)`` of the tree with four ghosts on every branch.

    X0 takes a node's place under its parent, at half the branch; X1 and then the node hang from it;
    X1 has two leaves. Ghosts are numbered in post-order, after the number of nodes.
    """
    n = tree.count()
    rows = ghost_lengths(tree)
    x = [_ghost(n, i) for i in range(4)]
    node = lambda label, parent, length, ord_: F.struct(label.alias("label"), parent.alias("parent"), length.alias("branch_length"), ord_.cast("long").alias("child_ord"))
    short = F.lit(GHOST_LEAF_LENGTH)
    made = F.array(
        node(x[0], F.col("parent"), F.col("x0_length"), F.col("postorder")),
        node(x[1], x[0], F.col("x1_length"), F.lit(0)),
        node(F.col("label"), x[0], F.col("own_length"), F.lit(1)),
        node(x[2], x[1], short, F.lit(0)),
        node(x[3], x[1], short, F.lit(1)),
    )
    root = tree.where("parent is null").select("label", "parent", "branch_length", F.lit(0).cast("long").alias("child_ord"))
    return rows.select(F.inline(made)).unionByName(root)


def ghost_mapping(tree: DataFrame) -> DataFrame:
    """``(label, original)``: the ghosts X0 and X1 of each branch, and its node's postorder id."""
    n = tree.count()
    both = F.array(_ghost(n, 0), _ghost(n, 1))
    return tree.where("parent is not null").select(F.explode(both).alias("label"), F.col("postorder").alias("original"))


def is_ghost(label, strategy: str = "both"):
    inner, outer = label.endswith("_X0"), label.endswith("_X1")
    return {"both": inner | outer, "inner-only": inner, "outer-only": outer}[strategy]


def ghost_groups(mapping: DataFrame, strategy: str = "both") -> DataFrame:
    """The ghosts of each original node."""
    return mapping.where(is_ghost(F.col("label"), strategy)).groupBy("original").agg(F.sort_array(F.collect_list("label")).alias("ghosts"))


def with_orders(tree: DataFrame, depth: bool = False) -> DataFrame:
    """Add ``postorder`` and ``preorder`` (and ``depth``, the number of ancestors, if asked) to ``(label, parent, branch_length[, child_ord])``, children in that order, then by label.

    A node comes one and the sizes of its earlier siblings after its parent; these steps are summed up to the root.
    What precedes it in post-order are also the rest of its subtree, but not its ancestors.
    """
    order = ["parent", *(["child_ord"] if "child_ord" in tree.columns else []), "label"]
    sizes = subtree_stats(tree).select("label", "n_nodes")
    rows = running_sums(ranked(tree.select(*order).join(sizes, "label"), *order), "n_nodes").select("label", "parent", "n_nodes", "before")
    rows = stored(rows)
    first = rows.groupBy("parent").agg(F.min("before").alias("first")).where("parent is not null")
    child = F.col("parent").isNotNull()
    step = F.when(child, F.col("before") - F.col("first") + 1).otherwise(0)
    paths = path_sums(rows.join(first, "parent", "left").select("label", F.col("parent").alias("up"), step.cast("long").alias("preorder"), child.cast("long").alias("depth")))
    orders = paths.join(rows.select("label", "n_nodes"), "label").select("label", (F.col("preorder") + F.col("n_nodes") - 1 - F.col("depth")).alias("postorder"), "preorder", *(["depth"] if depth else []))
    return tree.join(stored(orders), "label")


def newick_blocks(tree: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(block, text)``: the Newick text of a tree with orders and depths, in pieces that follow one another by block.

    A walk around the tree enters and leaves each node. Before a node is entered, all nodes of smaller preorder have been
    entered and all of these but its ancestors left, so that its place in the walk is twice its preorder less its
    depth; it is left at twice its postorder plus depth and one. Each place writes a short text, and places are joined in
    blocks of ``size``: nothing holds the tree. Labels are written as they are; a node of generated name (``#``) has none.
    """
    shown = F.when(F.col("label").startswith("#"), F.lit("")).otherwise(F.col("label"))
    length = F.when(F.col("parent").isNull(), F.lit(";")).otherwise(F.concat(F.lit(":"), F.coalesce(F.col("branch_length"), F.lit(0.0)).cast("string")))
    # a node after its parent's preorder follows a sibling unless it is the next one entered
    rows = is_leaf(tree).join(tree.select(F.col("label").alias("parent"), F.col("preorder").alias("above")), "parent", "left")
    comma = F.when(F.col("preorder") > F.col("above") + 1, F.lit(",")).otherwise(F.lit(""))
    enter = F.struct((2 * F.col("preorder") - F.col("depth")).alias("at"), F.concat(comma, F.when(F.col("is_leaf"), F.lit("")).otherwise(F.lit("("))).alias("piece"))
    leave = F.struct((2 * F.col("postorder") + F.col("depth") + 1).alias("at"), F.concat(F.when(F.col("is_leaf"), F.lit("")).otherwise(F.lit(")")), shown, length).alias("piece"))
    pieces = rows.select(F.inline(F.array(enter, leave)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")  # of size at most
    return pieces.groupBy(F.floor(F.col("at") / size).cast("long").alias("block")).agg(joined.alias("text"))


def reroot(tree: DataFrame) -> DataFrame:
    """An unrooted tree (a, b, c) as ((b, c), a)added_root; a root of two children stays.

    Returns ``(label, parent, branch_length, child_ord)``.
    """
    top = tree.where("parent is null").select(F.col("label").alias("top"))
    first = tree.join(top, F.col("parent") == F.col("top")).agg(F.min_by("label", "child_ord").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = tree.join(F.broadcast(top.join(first)))  # one row: the root, its first child and how many it has
    moves = F.col("n") > 2
    parent = F.when(moves & (F.col("parent").isNull() | (F.col("label") == F.col("first"))), F.lit("added_root")).otherwise(F.col("parent"))
    order = F.when(moves & F.col("parent").isNull(), F.lit(0)).when(moves & (F.col("label") == F.col("first")), F.lit(1)).otherwise(F.col("child_ord"))
    old = rows.select("label", parent.alias("parent"), "branch_length", order.cast("long").alias("child_ord"))
    added = first.where("n > 2").select(F.lit("added_root").alias("label"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("branch_length"), F.lit(0).cast("long").alias("child_ord"))
    return old.unionByName(added)


def is_rooted(tree: DataFrame) -> bool:
    root = tree.where("parent is null").select("label")
    return tree.join(root.select(F.col("label").alias("parent")), "parent", "left_semi").count() < 3


def map_nodes(extended: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """``(ext_label, ar_label)`` of two trees of one shape, by postorder; nodes without a label are left out."""
    a, b = extended.count(), reconstructed.count()
    if a != b:
        raise ValueError(f"trees differ in size: {a} and {b} nodes")
    both = extended.select(F.col("label").alias("ext_label"), "postorder").join(reconstructed.select(F.col("label").alias("ar_label"), "postorder"), "postorder")
    return both.where("ext_label <> '' and ar_label <> ''").select("ext_label", "ar_label")


def tree_index(tree: DataFrame) -> DataFrame:
    """``(postorder, num_nodes, subtree_length)`` of every node."""
    return tree.join(subtree_stats(tree), "label").select("postorder", F.col("n_nodes").alias("num_nodes"), "subtree_length")
