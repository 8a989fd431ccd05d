"""Windows over probability matrices, and the k-mers whose probability exceeds a threshold there.

A matrix is ``(node, site int, logp array<double>, best double)``: log10 probabilities of each state
and the best of them. Sites of a node that are missing count as impossible, as do windows with one.
Five engines enumerate the same k-mers; all use the bound that a part of a k-mer, completed by the
best states of the other sites, has to exceed the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twigmer.functions.scoring import append_code, append_state, log_probability
from twigmer.operators.sum_threshold import joined, strings

#: Windows of one task's unit of work in the numpy engine.
BLOCK_WINDOWS = 64
#: K-mers that a task of the numpy engine holds before it keeps the best of each, and rows of a batch that engines pass on.
HELD, BATCH = 1 << 20, 1 << 16


def pack(cells: DataFrame, sigma: int) -> DataFrame:
    """``cells(node, site, state, p)`` -> matrix; states without a cell have probability zero."""
    by_state = F.map_from_entries(F.collect_list(F.struct("state", "p")))
    packed = cells.groupBy("node", F.col("site").cast("int").alias("site")).agg(by_state.alias("m"))
    logp = F.transform(F.sequence(F.lit(0), F.lit(sigma - 1)), lambda s: log_probability(F.coalesce(F.col("m")[s], F.lit(0.0))))
    return with_best(packed.select("node", "site", logp.alias("logp")))


def with_best(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("best", F.array_max("logp"))


#: Folders of a stored matrix; a node's sites are in one.
MATRIX_PARTS = 64


def matrix_part(node: Column) -> Column:
    return F.pmod(F.xxhash64(node.cast("string")), F.lit(MATRIX_PARTS)).cast("int")


def write_matrix(path: str, matrix: DataFrame) -> None:
    """Store a matrix in folders by a hash of the node, sorted by node and site."""
    rows = matrix.withColumn("part", matrix_part(F.col("node")))
    rows.repartition("part").sortWithinPartitions("part", "node", "site").write.partitionBy("part").parquet(path)


def read_matrix(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The sites of the ``wanted(node)``; folders without any of them aren't read (dynamic partition pruning)."""
    nodes = wanted.select("node", matrix_part(F.col("node")).alias("part")).distinct()
    return spark.read.parquet(path).join(nodes, ["part", "node"], "left_semi").drop("part")


def frame(first: int, last: int):
    return Window.partitionBy("node").orderBy("site").rowsBetween(first, last)


def prefix_sums(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("prefix", F.sum("best").over(frame(Window.unboundedPreceding, 0)))


def range_best(matrix: DataFrame, length: int) -> DataFrame:
    """For each site, the sum of best scores of ``length`` sites from it; only where all exist."""
    made = matrix.withColumn("range_best", F.sum("best").over(frame(0, length - 1))).withColumn("__whole", _whole(0, length))
    return made.where("__whole").drop("__whole")


def _whole(offset: int, k: int) -> Column:
    """Whether the window of k sites that starts ``offset`` rows before this one exists without a gap."""
    w = frame(-offset, k - 1 - offset)
    return (F.count("site").over(w) == k) & (F.max("site").over(w) - F.min("site").over(w) == k - 1)


def windows(matrix: DataFrame, k: int) -> DataFrame:
    """``(node, position, win)``: all windows of k consecutive sites; none if there are fewer."""
    win = F.collect_list(F.struct("site", "logp", "best")).over(frame(0, k - 1))
    made = matrix.select("node", F.col("site").alias("position"), win.alias("win"))
    return made.where((F.size("win") == k) & (F.col("win")[k - 1]["site"] - F.col("position") == k - 1))


def chained_windows(matrix: DataFrame, k: int) -> DataFrame:
    """Windows with their neighbours in chains of stride k - k // 2, one chain for each residue."""
    step = k - k // 2
    w = Window.partitionBy("node", F.pmod("position", F.lit(step))).orderBy("position")
    at = windows(matrix, k).select("node", "position")
    near = lambda c: F.when(F.abs(c - F.col("position")) == step, c)
    return at.select("node", "position", near(F.lag("position").over(w)).alias("previous"), near(F.lead("position").over(w)).alias("next"))


def best_state(matrix: DataFrame) -> DataFrame:
    """The likeliest state of each site, the first of equals."""
    return matrix.select("node", "site", (F.array_position("logp", F.col("best")) - 1).cast("int").alias("state"), "best")


def enumerate_hof(matrix: DataFrame, k: int, sigma: int, eps: float) -> DataFrame:
    """One array per window, extended site by site by higher-order functions."""
    rest = {f"rest{i}": F.coalesce(F.sum("best").over(frame(i + 1, k - 1)), F.lit(0.0)) if i + 1 < k else F.lit(0.0) for i in range(k)}
    win = F.collect_list(F.struct("site", "logp")).over(frame(0, k - 1))
    made = matrix.select("node", F.col("site").alias("position"), win.alias("win"), *[c.alias(n) for n, c in rest.items()])
    made = made.where((F.size("win") == k) & (F.col("win")[k - 1]["site"] - F.col("position") == k - 1))

    def extend(parts: Column, i: int) -> Column:
        state = lambda e, s: F.struct(append_state(e["code"], s, sigma).alias("code"), (e["score"] + F.get(F.col("win")[i]["logp"], s)).alias("score"))
        each = lambda e: F.transform(F.sequence(F.lit(0), F.lit(sigma - 1)), lambda s: state(e, s))
        return F.filter(F.flatten(F.transform(parts, each)), lambda e: e["score"] + F.col(f"rest{i}") > eps)

    parts = F.array(F.struct(F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("score")))
    for i in range(k):
        parts = extend(parts, i)
    return made.select("node", "position", F.inline(parts))


def enumerate_join(matrix: DataFrame, k: int, sigma: int, eps: float) -> DataFrame:
    """Prefixes joined with suffixes of the same window, down to single sites."""

    def part(offset: int, length: int) -> DataFrame:
        if length == 1:
            total = F.sum("best").over(frame(-offset, k - 1 - offset))
            sites = matrix.select("node", (F.col("site") - offset).alias("position"), "logp", "best", total.alias("total"), _whole(offset, k).alias("whole"))
            sites = sites.where("whole").where(F.col("total") > float("-inf"))
            rows = sites.select("node", "position", "best", "total", F.posexplode("logp").alias("state", "score"))
            rows = rows.select("node", "position", F.col("state").cast("long").alias("code"), "score", "best", "total")
        else:
            h = length // 2
            a, b = part(offset, h).alias("a"), part(offset + h, length - h).alias("b")
            both = a.join(b, ["node", "position"])
            code = append_code(F.col("a.code"), F.col("b.code"), length - h, sigma)
            rows = both.select("node", "position", code.alias("code"), (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.best") + F.col("b.best")).alias("best"), F.col("a.total").alias("total"))
        return rows.where(F.col("score") + (F.col("total") - F.col("best")) > eps)

    return part(0, k).where(F.col("score") > eps).select("node", "position", "code", "score")


def enumerate_numpy(matrix: DataFrame, k: int, sigma: int, eps: float, every: bool = False) -> DataFrame:
    """Blocks of windows in numpy. Unless ``every``, a block passes on each code once, at its best and first place."""
    block = lambda site: F.floor(site / F.lit(BLOCK_WINDOWS)).cast("int")
    last = block(F.col("site"))
    first = F.greatest(block(F.col("site") - (k - 1)), F.lit(0))  # a site also serves windows that start before it
    dealt = matrix.select("node", "site", "logp", F.explode(F.sequence(F.least(first, last), last)).alias("block"))
    node = matrix.schema["node"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("site")
        own, start = table.column("node")[0].as_py(), table.column("block")[0].as_py() * BLOCK_WINDOWS
        sites = table.column("site").to_numpy()
        logp = np.array(table.column("logp").to_pylist(), dtype=np.float64).reshape(-1, sigma)
        best = logp.max(axis=1)
        held, n = [], 0

        def kept() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            codes, scores, at = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*held, strict=True), (np.int64, np.float64, np.int32), strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))
            if not every:
                order = np.lexsort((at, -scores, codes))
                lead = order[np.r_[True, np.diff(codes[order]) != 0][: len(order)]]
                codes, scores, at = codes[lead], scores[lead], at[lead]
            return [(codes, scores, at)]

        for i in range(len(sites) - k + 1):
            if sites[i + k - 1] - sites[i] != k - 1 or not start <= sites[i] < start + BLOCK_WINDOWS:
                continue
            codes, scores = np.zeros(1, np.int64), np.zeros(1)
            for j in range(k):
                rest = best[i + j + 1 : i + k].sum()
                scores = (scores[:, None] + logp[i + j]).ravel()
                codes = (codes[:, None] * sigma + np.arange(sigma)).ravel()
                keep = scores + rest > eps
                codes, scores = codes[keep], scores[keep]
            held.append((codes, scores, np.full(len(codes), sites[i], np.int32)))
            n += len(codes)
            if n > HELD and not every:  # windows meet the best so far, not all earlier ones
                held = kept()
                n = len(held[0][0])
        ((codes, scores, at),) = kept()
        return pa.table({"node": pa.array([own] * len(codes), table.schema.field("node").type), "position": at, "code": codes, "score": scores})

    return dealt.groupBy("node", "block").applyInArrow(run, f"node {node}, position int, code long, score double")


def _passed_on(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The strings ``(row, codes, scores)`` of windows with their node and position, in batches of bounded size."""
    if not found:
        return
    at = np.repeat([r for r, *_ in found], [len(c) for _, c, _ in found])
    codes, scores = (np.concatenate([f[i] for f in found]) for i in (1, 2))
    for i in range(0, len(at), BATCH):
        rows = pa.array(at[i : i + BATCH])
        columns = [batch.column("node").take(rows), batch.column("position").take(rows), pa.array(codes[i : i + BATCH]), pa.array(scores[i : i + BATCH])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "position", "code", "score"])


def _in_turn(run: Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run(batch, row)`` for each window; results are passed on as soon as a batch of them is full."""

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for row in range(batch.num_rows):
                found.append((row, *run(batch, row)))
                n += len(found[-1][1])
                if n >= BATCH:
                    yield from _passed_on(batch, found)
                    found, n = [], 0
            yield from _passed_on(batch, found)

    return all_rows


def _list_at(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """A row's list, without copying."""
    lists = batch.column(column)
    a, b = lists.offsets[row].as_py(), lists.offsets[row + 1].as_py()
    return lists.values.slice(a, b - a).to_numpy(zero_copy_only=False)


def enumerate_sorted(matrix: DataFrame, k: int, sigma: int, eps: float) -> DataFrame:
    """Windows halved down to sites; two halves are joined by :func:`.sum_threshold.threshold_pairs`, so that no pair that fails is made."""
    node = matrix.schema["node"].dataType.simpleString()
    rows = windows(matrix, k).select("node", "position", F.flatten(F.transform("win", lambda x: x["logp"])).alias("logp"))
    run = _in_turn(lambda batch, row: strings(_list_at(batch, "logp", row).reshape(k, sigma), eps))
    return rows.mapInArrow(run, f"node {node}, position int, code long, score double")


def half_lists(matrix: DataFrame, k: int, sigma: int, eps: float) -> DataFrame:
    """``(node, position, codes, scores, middle, whole)``: for each site, the strings of k // 2 sites from it that any window needs.

    Such a half begins the window at its position and ends the window k - k // 2 sites before: the looser of both
    bounds holds. ``middle`` is the site between the halves of the window that begins here (odd k, else null);
    ``whole`` says that there is such a window.
    """
    h, step = k // 2, k - k // 2
    order = Window.partitionBy("node").orderBy("site")
    bound = lambda whole, first, last: F.when(whole, F.lit(eps) - F.sum("best").over(frame(first, last)))
    begins, ends = bound(_whole(0, k), h, k - 1), bound(_whole(step, k), -step, -1)
    middle = F.lead("logp", h).over(order) if step > h else F.lit(None).cast("array<double>")
    rows = matrix.select("node", F.col("site").alias("position"), F.flatten(F.collect_list("logp").over(frame(0, h - 1))).alias("logp"), F.least(begins, ends).alias("need"), middle.alias("middle"), _whole(0, k).alias("whole"))
    node = matrix.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [strings(_list_at(batch, "logp", i).reshape(h, sigma), need) for i, need in enumerate(batch.column("need").to_numpy())]
            lists = [pa.array([m[i] for m in made], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("position"), *lists, batch.column("middle"), batch.column("whole")], ["node", "position", "codes", "scores", "middle", "whole"])

    return rows.where("need is not null").mapInArrow(run, f"node {node}, position int, codes array<long>, scores array<double>, middle array<double>, whole boolean")


def enumerate_chained(matrix: DataFrame, k: int, sigma: int, eps: float) -> DataFrame:
    """Chains of windows, k - k // 2 sites apart: the last half of a window is the first of the next, and is made once.

    For odd k, the site between a window's halves goes before its last half.
    """
    if k == 1:
        return enumerate_sorted(matrix, k, sigma, eps)
    h, step = k // 2, k - k // 2
    node = matrix.schema["node"].dataType.simpleString()
    chain = Window.partitionBy("node", F.pmod("position", F.lit(step))).orderBy("position")
    after = F.lead(F.struct("position", "codes", "scores")).over(chain)
    rows = half_lists(matrix, k, sigma, eps).withColumn("after", after).where(F.col("whole") & (F.col("after.position") == F.col("position") + step))
    rows = rows.select("node", "position", "codes", "scores", "middle", F.col("after.codes").alias("next_codes"), F.col("after.scores").alias("next_scores"))

    def window(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = ((_list_at(batch, f"{side}codes", row), _list_at(batch, f"{side}scores", row)) for side in ("", "next_"))
        if step > h:
            middle = _list_at(batch, "middle", row)
            least = eps - first[1].max(initial=-np.inf) - 1e-9
            last = joined((np.arange(sigma), middle), last, h, sigma, least)
        return joined(first, last, step, sigma, eps)

    return rows.mapInArrow(_in_turn(window), f"node {node}, position int, code long, score double")


ENGINES: dict[str, Callable[..., DataFrame]] = {"hof": enumerate_hof, "join": enumerate_join, "numpy": enumerate_numpy, "sorted": enumerate_sorted, "chained": enumerate_chained}


def enumerate_kmers(matrix: DataFrame, k: int, sigma: int, eps: float, engine: str = "numpy") -> DataFrame:
    """``(node, position, code, score)`` of the k-mers above the threshold ``eps`` (log10), strictly."""
    return ENGINES[engine](matrix, k, sigma, eps)
