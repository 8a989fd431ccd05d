"""Links between the members of hash buckets, verified against bucket representatives; nothing emits all pairs of a group.

Every member of a bucket is verified against the bucket's first. Members that pass are connected through
it, so only those that fail are compared with the other members, in blocks that spread over tasks. Copies
share many buckets with one first member: what is compared are the members of all buckets of a first, once. Where
buckets are told apart, members that meet no other component in one are left out, and what is compared are the
members of all buckets whose firsts are of one component, once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import connected_components, stored

#: Members of a block that one task compares with another block, and so many times as many if it has sketches only.
BLOCK, SKETCHES = 512, 4


def members_of(buckets: DataFrame) -> DataFrame:
    """``(key, id, first)`` of the buckets ``(key, id)``: the members of each with its smallest id, without that itself."""
    ends = buckets.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    return buckets.join(ends, "key").where("id <> first")


def jaccard(a: Column, b: Column) -> Column:
    """The exact similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _by_id(members: DataFrame) -> DataFrame:
    """``(id, firsts)``: a row for each member, so that what is known of it is joined once; a member has as many firsts as lookups at most."""
    return members.groupBy("id").agg(F.collect_list("first").alias("firsts"))


def candidates(members: DataFrame, known: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """The ``members(id, first)`` that ``near`` holds for, given what is ``known(id, value)`` of the two."""
    wide = _by_id(members).join(known, "id").select("id", "value", F.explode("firsts").alias("first"))
    return wide.join(known.select(F.col("id").alias("first"), F.col("value").alias("of_first")), "first").where(near(F.col("value"), F.col("of_first"))).select("id", "first")


def bucket_links(members: DataFrame, check: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], near: Callable[[list, list], np.ndarray], close: DataFrame | None = None, sketch: tuple[DataFrame, DataFrame, Callable] | None = None) -> DataFrame:
    """The verified links ``(a, b)`` of ``members(id, first)``, stored and distinct, see :func:`members_of`.

    ``check(pairs)`` returns those of ``pairs(a, b)`` that are linked; it is asked of the rows of ``close``
    only (stored, a part of ``members``) if that is given. ``sets_of(ids)`` gives ``(id, payload array<long>)``
    and ``near(left, right)`` the exact verdict on two lists of payloads as a boolean matrix. A ``sketch`` has
    the members by bucket, ``(key, id, first)`` (stored), payloads and their verdict: it leaves out members that
    meet no other component in a bucket, or are near none there. Links that only repeat a connection are left out.
    """
    close = members if close is None else close
    # one representative for each member first: in a large group that settles nearly all
    lowest = stored(close.groupBy("id").agg(F.min("first").alias("first")))
    settled = stored(check(lowest.select(F.col("id").alias("a"), F.col("first").alias("b"))))
    label = settled.select(F.col("a").alias("id"), F.col("b").alias("label"))
    rest = close.join(lowest, ["id", "first"], "left_anti")
    rest = rest.join(label, "id", "left").join(label.select(F.col("id").alias("first"), F.col("label").alias("of_first")), "first", "left")
    apart = F.coalesce("label", "id") != F.coalesce("of_first", "first")
    rest = stored(rest.where(apart).select(F.col("id").alias("a"), F.col("first").alias("b")))
    linked = stored(settled.unionByName(check(rest)))
    if sketch is None:
        rows = _open_rows(members, linked)
    else:
        keyed, payload, verdict = sketch
        groups = _open_groups(keyed, linked)
        rows = _dealt(groups, SKETCHES * BLOCK)
        if rows is not None:
            near_some = _compared(rows.join(payload, "id"), verdict, ids_only=True).select(F.col("a").alias("id"), F.col("b").alias("group"))
            rows = _dealt(groups.join(near_some, ["id", "group"], "left_semi"), BLOCK)
    if rows is None:
        return linked
    sets = sets_of(rows.select("id"))
    return linked.unionByName(_compared(rows.join(sets, "id"), near, ids_only=False))


def _roots(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``(id, root)`` of members and firsts, stored; what has no link is its own root."""
    ids = members.select("id").unionByName(members.select(F.col("first").alias("id"))).distinct()
    return stored(ids.join(connected_components(linked), "id", "left").select("id", F.coalesce("root", "id").alias("root")))


def _open_groups(keyed: DataFrame, linked: DataFrame) -> DataFrame:
    """``(id, root, group)``, stored and distinct: the members of buckets that hold two components besides the first; ``group`` is the root of the bucket's first.

    The first has been compared with every member, so that a bucket of one more component is done.
    """
    roots = _roots(keyed, linked)
    wide = keyed.groupBy("id").agg(F.collect_list(F.struct("key", "first")).alias("met")).join(roots, "id").select("id", "root", F.inline("met"))
    met = wide.join(roots.select(F.col("id").alias("first"), F.col("root").alias("of_first")), "first")
    bucket = Window.partitionBy("key")
    met = met.select("id", "root", F.col("of_first").alias("group"), F.min("root").over(bucket).alias("low"), F.max("root").over(bucket).alias("high"))
    return stored(met.where("low < high").select("id", "root", "group").distinct())


def _dealt(groups: DataFrame, block: int) -> DataFrame | None:
    """``(id, root, cells)`` as in :func:`_open_rows`, of groups with two components; all members but those of the most common one count as failed."""
    roots = groups.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = roots.groupBy("group").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("most")).where("m > most.n")
    blocks = lambda c: F.ceil(c / block).cast("int")
    sizes = stored(sizes.select("group", blocks(F.col("m") - F.col("most.n")).alias("n"), blocks(F.col("m")).alias("m"), F.col("most.root").alias("most")))
    if sizes.isEmpty():
        return None
    cell = F.struct(F.col("group").alias("first"), "n", "m", (F.col("root") != F.col("most")).alias("fails"))
    return stored(groups.join(sizes, "group").groupBy("id", "root").agg(F.collect_list(cell).alias("cells")))


def _open_rows(members: DataFrame, linked: DataFrame) -> DataFrame | None:
    """``(id, root, cells)``, a row for each member of a first in whose buckets one is in another component than the first, if there are others to compare it with.

    ``cells(first, n, m, fails)``: the firsts of the member, in how many blocks their failed and all members
    are compared, and whether this one has failed.
    """
    roots = _roots(members, linked)
    wide = _by_id(members).join(roots, "id").select("id", "root", F.explode("firsts").alias("first"))
    met = wide.join(roots.select(F.col("id").alias("first"), F.col("root").alias("of_first")), "first")
    # what is connected with its first, by way of others too, hasn't failed
    failed = stored(met.where("root <> of_first").drop("of_first"))
    sizes = failed.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    # a first with no other member has nothing left to compare
    firsts = sizes.join(members.groupBy("first").agg(F.count(F.lit(1)).alias("m")), "first").where("m > 1")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    firsts = stored(firsts.select("first", blocks("n"), blocks("m")))
    if firsts.isEmpty():
        return None
    passed = met.where("root = of_first").drop("of_first")
    rows = failed.join(firsts, "first").withColumn("fails", F.lit(True)).unionByName(passed.join(firsts, "first").withColumn("fails", F.lit(False)))
    return stored(rows.groupBy("id", "root").agg(F.collect_list(F.struct("first", "n", "m", "fails")).alias("cells")))


def _compared(rows: DataFrame, near: Callable[[list, list], np.ndarray], ids_only: bool) -> DataFrame:
    """Near pairs ``(a, b)`` of failed members and others of their firsts, of each two components one a cell; or the ids of all near ones, with the first."""
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)

    def dealt(c: Column) -> Column:
        """Cells ``(first, i, j, side)``: a failed member is in one cell on both sides (2), else left (0); all are right (1) in the others of their column."""
        i, j = mine(c["n"]), mine(c["m"])
        cell = lambda i, j, side: F.struct(c["first"].alias("first"), i.alias("i"), j.alias("j"), side.alias("side"))
        right = F.transform(every(c["n"]), lambda x: cell(x, j, F.when(c["fails"] & (x == i), 2).otherwise(1)))
        left = F.transform(F.filter(every(c["m"]), lambda y: c["fails"] & (y != j)), lambda y: cell(i, y, F.lit(0)))
        return F.concat(right, left)

    names = ["first", "i", "j", "side", "id", "root", "payload"]
    cells = rows.select("id", "root", "payload", F.inline(F.flatten(F.transform("cells", dealt)))).select(*names)
    cells = cells.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j", "id")

    def spanning(pairs: np.ndarray) -> list[int]:
        """Of pairs of components, those that a forest needs."""
        own: dict[int, int] = {}

        def find(x: int) -> int:
            while own.setdefault(x, x) != x:
                x = own[x] = own[own[x]]
            return x

        kept = []
        for i, (a, b) in enumerate(pairs.tolist()):
            a, b = find(a), find(b)
            if a != b:
                own[b] = a
                kept.append(i)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            left, right = sides
            if left and right:
                ids, roots = ([np.array([x[c] for x in side]) for side in sides] for c in (0, 1))
                ok = near([x[2] for x in left], [x[2] for x in right]) & (roots[0][:, None] != roots[1])
                if ids_only:
                    a = np.union1d(ids[0][ok.any(axis=1)], ids[1][ok.any(axis=0)])
                    b = np.full(len(a), at[0])
                else:
                    a, b = np.nonzero(ok)
                    pairs, where = np.unique(np.sort(np.stack([roots[0][a], roots[1][b]], axis=1), axis=1), axis=0, return_index=True)
                    where = where[spanning(pairs)] if len(where) else where
                    a, b = ids[0][a[where]], ids[1][b[where]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            left.clear()
            right.clear()

        for batch in batches:
            lists = batch.column("payload")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (first, x, y, side, own, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in names[:-1]), strict=True)):
                if (first, x, y) != at:
                    yield from close()
                    at = (first, x, y)
                row = (own, root, values[ends[i] : ends[i + 1]].copy())
                for one in (0, 1) if side == 2 else (side,):
                    sides[one].append(row)
        yield from close()

    return stored(cells.mapInArrow(run, "a long, b long").distinct())
