"""Hard negatives of anchors, by exact inner products scored with the method of four Russians.

Components are integers. Each anchor has a table for every group of eight dimensions, with the sum of each of
the group's 256 subsets of the anchor's components. A candidate is stored as bit planes: for every bit of its
components in two's complement, one byte a group. A plane's bytes look up their subset sums, and the planes'
sums, shifted and added from the highest, are the exact inner product.

Anchors and candidates are dealt to the cells of a grid, some ANCHORS x ROWS each, so that no task holds more
than one cell; a cell passes on the first few rows of each anchor only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Anchors and other rows of a cell, on average.
ANCHORS, ROWS = 128, 4096
#: Positives of an anchor, negatives of a positive, and the range of negatives in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
SCALE = 256
_CELL = ["i", "j", "side"]


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as longs; what exceeds a long is the nearest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """``(rows, planes, groups)`` bytes of ``q(rows, 8 x groups)``; bit k of a byte is that of dimension k of its group."""
    bits = (q[:, None, :] >> np.arange(planes)[None, :, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``(groups, 256, anchors)``: the sums of each subset of eight components of ``anchors(anchors, 8 x groups)``."""
    n, dims = anchors.shape
    by_group = anchors.reshape(n, dims // 8, 8).transpose(1, 2, 0)
    out = np.zeros((dims // 8, 256, n), anchors.dtype)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + by_group[:, k, None]
    return out


def looked_up(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``(rows, anchors)``: the inner products of ``planes(rows, planes, groups)`` with the anchors of ``sums``."""
    total = np.zeros((len(planes), sums.shape[2]), sums.dtype)
    top = planes.shape[1] - 1
    for p in range(top, -1, -1):
        part = np.zeros_like(total)
        for g in range(len(sums)):
            part += sums[g].take(planes[:, p, g], axis=0)
        total = -part if p == top else (total << 1) + part  # the highest bit of two's complement is negative
    return total


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers; what shorter ones lack is zero."""
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[ends[0] : ends[-1]]
    out = np.zeros((len(lists), dims), np.int64)
    sizes = np.diff(ends)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def _in_cells(cells: DataFrame, work: Callable[[pa.Table, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work(anchors, candidates)`` of each cell; rows are sorted by cell and side, a cell's rows alone are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1] and (out := work(*(pa.Table.from_batches(s).combine_chunks() for s in sides))) is not None:
                yield out
            for s in sides:
                s.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, side = (batch.column(c).to_numpy() for c in _CELL)
            cuts = np.r_[0, np.nonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0))[0] + 1, len(i)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (cell := (i[a], j[a])) != at:
                    yield from done()
                    at = cell
                sides[side[a]].append(batch.slice(a, b - a))
        yield from done()

    return cells.mapInArrow(run, schema)


class Grid:
    """Anchors and candidates as packed tables, and the cells that compare them."""

    def __init__(self, rows: DataFrame):
        """``rows(vec_id, label, q, is_anchor)``, ``q`` of any lengths; they are numbered and written once."""
        self.rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        some = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        low, high = some(F.min(F.array_min("q"))), some(F.max(F.array_max("q")))
        n, anchors, dims, low, high = self.rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.coalesce(F.max(F.size("q")), F.lit(0)), low, high).first()
        self.dims = max(8, -(-dims // 8) * 8)
        self.planes = max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) + 1
        self.dtype = np.int32 if self.dims.bit_length() + 2 * self.planes < 31 else np.int64
        self.i, self.j = max(1, -(-anchors // ANCHORS)), max(1, -(-n // ROWS))
        groups, planes, dims = self.dims // 8, self.planes, self.dims

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = bit_planes(_matrix(batch.column("q"), dims), planes)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(planes * groups), batch.num_rows, [None, pa.py_buffer(made.tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label")), packed.cast(pa.binary())], ["row", "vec_id", "label", "planes"])

        vec_id = self.rows.schema["vec_id"].dataType.simpleString()
        self.packed = stored(self.rows.drop("is_anchor").mapInArrow(pack, f"row long, vec_id {vec_id}, label long, planes binary"))
        self.anchors = self.rows.where("is_anchor").drop("is_anchor")

    def cells(self, anchors: DataFrame) -> DataFrame:
        """The rows of all cells: ``anchors`` in blocks (side 0) against all candidates in blocks (side 1), in order of ties."""
        place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = anchors.withColumn("i", place(self.i)).withColumn("j", every(self.j)).withColumn("side", F.lit(0))
        right = self.packed.withColumn("j", place(self.j)).withColumn("i", every(self.i)).withColumn("side", F.lit(1))
        # a number of its own: cells are small in bytes and long in work, which adaptive coalescing can't see
        dealt = left.unionByName(right, allowMissingColumns=True).repartition(min(self.i * self.j, 8192), "i", "j")
        return dealt.sortWithinPartitions(*_CELL, F.asc_nulls_last("vec_id"), "label", "row")

    def scorer(self) -> tuple[Callable, Callable]:
        """Subset sums of a cell's anchors, and planes of its candidates."""
        dims, planes, dtype = self.dims, self.planes, self.dtype
        sums = lambda a: subset_sums(_matrix(a.column("q").chunk(0), dims).astype(dtype))

        def unpacked(c: pa.Table) -> np.ndarray:
            column = c.column("planes").chunk(0)
            start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
            return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * planes * dims // 8].reshape(len(column), planes, dims // 8)

        return sums, unpacked


def positives_of(grid: Grid, n: int = POSITIVES) -> DataFrame:
    """``(row, positives)``: the first ``n`` other rows of each anchor's label, by score, then vec_id (nulls last), then row."""
    sums_of, planes_of = grid.scorer()
    vec_id = grid.rows.schema["vec_id"].dataType.simpleString()

    def work(anchors: pa.Table, others: pa.Table) -> pa.RecordBatch | None:
        sums, planes = sums_of(anchors), planes_of(others)
        of_a, of_b = anchors.column("label").to_numpy(), others.column("label").to_numpy()
        rows_a, rows_b = anchors.column("row").to_numpy(), others.column("row").to_numpy()
        out = []
        for label in np.unique(of_a):
            a, b = np.nonzero(of_a == label)[0], np.nonzero(of_b == label)[0]
            s = looked_up(sums[:, :, a], planes[b])
            first = np.argsort(-s, axis=0, kind="stable")[: n + 1]  # one more: an anchor may meet itself
            for k in range(len(a)):
                own = first[:, k][rows_b[b[first[:, k]]] != rows_a[a[k]]][:n]
                out.append((np.full(len(own), rows_a[a[k]]), b[own], s[own, k].astype(np.int64)))
        row, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(rows_b[at]), others.column("vec_id").take(pa.array(at)).combine_chunks(), pa.array(score)], ["row", "other", "vec_id", "score"])

    found = _in_cells(grid.cells(grid.anchors), work, f"row long, other long, vec_id {vec_id}, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other"))
    kept = found.withColumn("k", rank).where(F.col("k") <= n)
    return kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("positives"))  # n at most


def negatives_of(grid: Grid, positives: DataFrame, n: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The first ``n`` rows of other labels for each anchor and positive, of scores from ``least`` to ``most`` hundredths of the positive's."""
    sums_of, planes_of = grid.scorer()
    vec_id = grid.rows.schema["vec_id"].dataType.simpleString()
    names = ["row", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_label", "negative_row", "negative_score"]

    def work(anchors: pa.Table, others: pa.Table) -> pa.RecordBatch | None:
        s = looked_up(sums_of(anchors), planes_of(others)).T.astype(np.int64)
        labels = others.column("label").to_numpy()
        out, a_at, ids = [], [], []
        for a, (label, pos) in enumerate(zip(anchors.column("label").to_pylist(), anchors.column("positives").to_pylist(), strict=True)):
            ranges = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in pos]
            low, high = min(r[0] for r in ranges), max(r[1] for r in ranges)
            own = np.nonzero((labels != label) & (s[a] >= low) & (s[a] <= high))[0]
            own = own[np.argsort(-s[a][own], kind="stable")]
            down = -s[a][own]
            for p, (low, high) in zip(pos, ranges, strict=True):
                at = own[np.searchsorted(down, -high) :][:n]
                at = at[s[a][at] >= low]
                out.append((np.full(len(at), p["k"]), np.full(len(at), p["score"]), at, s[a][at]))
                a_at.append(np.full(len(at), a))
                ids += [p["vec_id"]] * len(at)
        if not ids:
            return None
        k, score, at, found = (np.concatenate(x) for x in zip(*out, strict=True))
        pick = lambda t, c, at: t.column(c).take(pa.array(at)).combine_chunks()
        a_at = np.concatenate(a_at)
        columns = [pick(anchors, "row", a_at), pa.array(k.astype(np.int32)), pick(anchors, "vec_id", a_at), pa.array(ids, anchors.schema.field("vec_id").type), pa.array(score), pick(others, "vec_id", at), pick(others, "label", at), pick(others, "row", at), pa.array(found)]
        return pa.RecordBatch.from_arrays(columns, names)

    found = _in_cells(grid.cells(grid.anchors.join(positives, "row")), work, f"row long, k int, anchor_id {vec_id}, positive_id {vec_id}, positive_score long, negative_id {vec_id}, negative_label long, negative_row long, negative_score long")
    order = Window.partitionBy("row", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_label", "negative_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | str = "label", vector: Column | str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the anchors among ``rows(vec_id, ...)``.

    Rows with a null label or vector, or with a component that is null or not finite, take no part. An anchor's
    positives are the first 5 other rows of its label; a positive's negatives are the first 10 rows of other
    labels within 30 to 90 hundredths of its score. Higher scores come first, ties by smaller vec_id (nulls last),
    then label, then the row's place. Shorter vectors count as filled up with zeros, an empty one scores zero.
    Repeated rows are rows of their own, repeated anchors repeat their results; a null vec_id is an id like any
    other. Scores are exact where they fit a long and wrap beyond. An empty table, or one without anchors, gives
    no rows; columns of other names are ignored.
    """
    label, vector = (F.col(c) if isinstance(c, str) else c for c in (label, vector))
    kept = rows.where(label.isNotNull() & usable(vector))
    grid = Grid(kept.select("vec_id", label.cast("long").alias("label"), quantised(vector).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")))
    found = negatives_of(grid, stored(positives_of(grid)))
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """The op12 contract, see :func:`hard_negatives`: anchors are rows whose vec_id is divisible by 100; every seventh has its label moved by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(embeddings, F.col("vec_id") % 100 == 0, moved)


ORACLE_SQL = """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
    from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b as p, score as ps from (select *, row_number() over (partition by a order by score desc, b) as k from s where same) where k <= 5),
n as (select p.a, p, b, ps, score, row_number() over (partition by p.a, p order by score desc, b) as rank from p join s on s.a = p.a where not same and 30 * ps <= 100 * score and 100 * score <= 90 * ps)
select a as anchor_id, p as positive_id, cast(rank as int) as rank, b as negative_id, ps as positive_score, score as negative_score from n where rank <= 10"""
