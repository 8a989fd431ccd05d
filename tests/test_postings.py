"""Posting blocks, lookups, exact quantiles, streaming state, Newick text in blocks, gap counts."""

import random

import pytest
from pyspark.sql import functions as F

from twigmer.operators import alignment as al
from twigmer.operators import posting_blocks as pb
from twigmer.operators import tree as tr
from twigmer.operators.quantiles import hazen_quantiles
from twigmer.sources import text_formats as tf
from twigmer.streaming.best_scores import run_to_end


def test_blocks_hold_no_more_than_their_branches(spark):
    rng = random.Random(1)
    rows = [(b, c, -rng.random()) for c in range(5) for b in range(1000) if c == 0 or rng.random() < 0.02 * c]  # one k-mer that all branches have
    best = spark.createDataFrame(rows, "branch int, code long, score double").repartition(7)
    blocks = pb.posting_blocks(best, 64)
    made = blocks.collect()
    assert max(r.n for r in made) == 64 and all(r.n == len(r.steps) == len(r.scores) for r in made)
    assert all(r.best == max(r.scores) and r.steps[0] == 0 and r.steps == sorted(r.steps) and r.steps[-1] < 64 for r in made)
    assert sorted((r.branch, r.code, r.score) for r in pb.entries(blocks).collect()) == sorted(rows)
    assert sorted((r.branch, r.code, r.score) for r in pb.above(blocks, -0.01).collect()) == sorted(r for r in rows if r[2] > -0.01)
    assert pb.entries(pb.posting_blocks(best.limit(0))).count() == 0


def scanned_rows(df):
    """Rows that the scan passed on, from the metrics of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_read_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 4).cast("int").alias("branch"), (F.col("id") * 7919 % 50_021).alias("code"), (-F.rand(3)).alias("score"))
    path = str(tmp_path / "by_code")
    pb.write_by_code(path, rows, group_bytes=64 << 10)
    every = spark.read.parquet(path)
    total = every.count()
    wanted = [17, 40_000, 49_999, 60_000]
    found = pb.lookup(spark, path, wanted)
    assert scanned_rows(found) < total / 5  # other row groups and pages are left out
    want = sorted(map(tuple, every.where(F.col("code").isin(wanted)).collect()), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want and {r[0] for r in want} == set(wanted[:3])
    table = spark.createDataFrame([(c,) for c in wanted * 2], "code long")
    assert sorted(map(tuple, pb.lookup(spark, path, table).collect()), key=str) == want
    with pytest.raises(ValueError, match="pass a table"):
        pb.lookup(spark, path, range(pb.PUSHED + 1))


def test_quantiles_of_groups_of_any_size(spark):
    rng = random.Random(2)
    groups = {"one": [5.0], "two": [1.0, 3.0], "ties": [2.0] * 50, "hot": [round(rng.random(), 3) for _ in range(9000)], None: [4.0, 1.0, 9.0], "none": [None]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("hot", None)], "g string, v double")
    for p in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r.g: (r.n, r.quantile) for r in hazen_quantiles(df, "v", p, "g").collect()}
        for g, values in groups.items():
            values = sorted(v for v in values if v is not None)
            if not values:
                assert g not in got
                continue
            at = max(0.0, min(len(values) * p - 0.5, len(values) - 1))
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert got[g][0] == len(values) and got[g][1] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))
    (whole,) = hazen_quantiles(df, "v", 0.5).collect()
    assert whole.n == sum(v is not None for _, v in rows)
    assert hazen_quantiles(df.limit(0), "v", 0.5, "g").count() == 0


def test_state_keeps_the_first_of_the_best_over_batches(spark, tmp_path):
    schema = "branch int, code long, score double, node_order long, position int"
    batches = [[(1, 5, -1.0, 3, 4), (1, 5, -1.0, 2, 9), (2, 5, -3.0, 1, 1)], [(1, 5, -0.5, 9, 9), (1, 6, -2.0, 1, 2)], [(1, 5, -0.5, 9, 7), (2, 5, -4.0, 0, 0)], [(1, 5, -1.0, 2, 9), (1, 5, -0.5, 9, 7)]]
    files = str(tmp_path / "kmers")
    for b in batches[:3]:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(files)
    got = run_to_end(spark, files, str(tmp_path / "run"))
    want = [(1, 5, -0.5, 9, 7), (1, 6, -2.0, 1, 2), (2, 5, -3.0, 1, 1)]
    assert sorted(map(tuple, got.collect())) == want
    spark.createDataFrame(batches[3], schema).coalesce(1).write.mode("append").parquet(files)  # rows that came before
    assert sorted(map(tuple, run_to_end(spark, files, str(tmp_path / "run")).collect())) == want


@pytest.mark.parametrize("size", [3, 4096])
def test_newick_text_in_blocks_parses_to_the_same_tree(spark, size):
    rng = random.Random(size)
    rows = [("n0", None, 0.0, 0)] + [(f"n{i}", f"n{rng.randrange(max(0, i - 9), i)}", round(rng.random(), 3), i) for i in range(1, 60)]
    tree = spark.createDataFrame(rows, "label string, parent string, branch_length double, child_ord long")
    blocks = tr.newick_blocks(tr.with_orders(tree, depth=True), size).orderBy("block").collect()
    assert len(blocks) == -(-120 // size)
    text = "".join(b.text for b in blocks)
    nodes = tf.parse_newick(text)
    name = {n["postorder"]: n["label"] for n in nodes}
    got = {(n["label"], name.get(n["parent_pos"]), n["branch_length"]) for n in nodes}
    assert got == {(a, b, c) for a, b, c, _ in rows} and text.endswith("n0;")
    order = [n["label"] for n in nodes if n["parent_pos"] is not None and name[n["parent_pos"]] == "n0"]
    assert order == sorted(order, key=lambda x: int(x[1:]))


def test_gap_ratios_of_odd_alignments(spark):
    rows = [(0, "a", "A-C-é-"), (1, "b", "--C---"), (2, "c", "A-日--G"), (3, "d", None)]
    a = spark.createDataFrame(rows, "seq_idx long, header string, seq string").repartition(3)
    assert [(r.site, round(r.ratio, 6)) for r in al.gap_ratios(a).orderBy("site").collect()] == [(0, 0.333333), (1, 1.0), (2, 0.0), (3, 1.0), (4, 0.666667), (5, 0.666667)]
    assert {r.header: r.seq for r in al.drop_gap_columns(a, 0.6).collect()} == {"a": "AC", "b": "-C", "c": "A日", "d": None}
    assert {r.seq for r in al.drop_gap_columns(a, 0.1).where("seq is not null").collect()} == {"C", "日"}
    assert {r.seq for r in al.drop_gap_columns(a, 0.0).where("seq is not null").collect()} == {""}
    assert al.gap_ratios(a.limit(0)).count() == 0


def test_only_folders_of_wanted_nodes_are_read(spark, tmp_path):
    from twigmer.operators import kmers

    rows = spark.range(4000).select((F.col("id") % 200).alias("node"), F.floor(F.col("id") / 200).cast("int").alias("site"), F.array(F.lit(-0.1), F.lit(-2.0)).alias("logp"), F.lit(-0.1).alias("best"))
    path = str(tmp_path / "matrix")
    kmers.write_matrix(path, rows)
    spark.createDataFrame([(i, "g" if i % 50 == 7 else "n") for i in range(200)], "node long, kind string").write.parquet(str(tmp_path / "ghosts"))
    wanted = spark.read.parquet(str(tmp_path / "ghosts")).where("kind = 'g'").select("node")
    found = kmers.read_matrix(spark, path, wanted)
    got = found.collect()
    assert sorted((r.node, r.site) for r in got) == [(n, s) for n in (7, 57, 107, 157) for s in range(20)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert scanned_rows(found) < 4000 / 4


def test_difference_report_counts_every_check(spark, tmp_path):
    from twigmer.operators import compare, database

    schema = "branch int, code long, score double"
    made = []
    for name, rows, omega in (("a", [(1, 5, -1.0), (2, 5, -1.5), (1, 6, -2.0)], 1.5), ("b", [(1, 5, -1.0), (2, 5, -1.2), (3, 7, -2.0), (3, 8, -2.0)], 1.5)):
        best, path = spark.createDataFrame(rows, schema), str(tmp_path / name)
        header = database.counts(best).select(F.lit("(x,y)r;").alias("tree"), F.lit(8).alias("k"), F.lit(omega).alias("omega"), "num_kmers", "num_entries")
        database.write_database(path, best, database.mif0(best, 0.01, 5), header)
        made.append(database.read_database(spark, path))
    got = {r.field: (r.a, r.b, r.same) for r in compare.difference_report(*made).collect()}
    assert got == {"tree": ("", "", True), "k": ("8", "8", True), "omega": ("1.5", "1.5", True), "num_kmers": ("2", "3", False), "num_entries": ("3", "4", False), "entries_of_one": ("1", "2", False), "scores": ("1", "1", False)}
    same = {r.field: r.same for r in compare.difference_report(made[0], made[0]).collect()}
    assert all(same.values()) and same.keys() == got.keys()
