"""Hand-worked fixtures, engines against brute force, and a build from files."""

import itertools
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twigmer.functions import scoring
from twigmer.operators import alignment as al
from twigmer.operators import compare, database, kmers
from twigmer.operators import tree as tr
from twigmer.plans import build as bd
from twigmer.plans.settings import BuildParams
from twigmer.sources import reconstruction as rc
from twigmer.sources import text_formats as tf
from twigmer.streaming.best_scores import best_scores

F1 = "((A:0.2,B:0.4)AB:0.6,C:1.0)root;"


def log10(p):
    return math.log10(p) if p > 0 else float("-inf")


def matrix(spark, rows):
    """rows: (node, site, [p...])"""
    return kmers.with_best(spark.createDataFrame([(n, s, [log10(x) for x in p]) for n, s, p in rows], "node string, site int, logp array<double>"))


def brute(rows, k, sigma, eps):
    sites = {}
    for n, s, p in rows:
        sites.setdefault(n, {})[s] = p
    out = set()
    for n, own in sites.items():
        for s in own:
            if all(s + i in own for i in range(k)):
                for w in itertools.product(range(sigma), repeat=k):
                    score = sum(log10(own[s + i][c]) for i, c in enumerate(w))
                    if score > eps:
                        out.add((n, s, sum(c * sigma ** (k - 1 - i) for i, c in enumerate(w)), round(score, 8)))
    return out


F2 = [("v", 0, [0.7, 0.1, 0.1, 0.1]), ("v", 1, [0.1, 0.7, 0.1, 0.1]), ("v", 2, [0.25] * 4)]


@pytest.mark.parametrize("engine", list(kmers.ENGINES))
def test_hand_worked_matrix(spark, engine):
    got = kmers.enumerate_kmers(matrix(spark, F2), 2, 4, scoring.log_threshold(1.5, 2, 4), engine)
    words = sorted(r.w for r in got.select(scoring.decode(F.col("code"), 2, "ACGT").alias("w")).collect())
    assert words == ["AC", "CA", "CC", "CG", "CT"]


@pytest.mark.parametrize("engine", list(kmers.ENGINES))
@pytest.mark.parametrize("k", [1, 2, 3])
def test_engines_equal_brute_force(spark, engine, k):
    import random

    rng = random.Random(k)
    rows = []
    for n in ("a", "b"):
        for s in range(70 if n == "a" else 9):
            if (n, s) in (("a", 5), ("b", 4)):
                continue  # a gap between sites
            w = [rng.random() ** 3 for _ in range(4)]
            rows.append((n, s, [0.0] * 4 if s == 7 else [x / sum(w) for x in w]))
    eps = scoring.log_threshold(1.2, k, 4)
    f = (lambda *a: kmers.enumerate_numpy(*a, every=True)) if engine == "numpy" else kmers.ENGINES[engine]
    got = {(r.node, r.position, r.code, round(r.score, 8)) for r in f(matrix(spark, rows), k, 4, eps).collect()}
    assert got == brute(rows, k, 4, eps)


def test_numpy_engine_passes_on_the_best_of_a_block(spark):
    rows = [("v", s, [0.9, 0.1, 0.0, 0.0] if s == 3 else [0.8, 0.2, 0.0, 0.0]) for s in range(6)]
    got = kmers.enumerate_numpy(matrix(spark, rows), 1, 4, -0.5).collect()
    assert [(r.code, r.position) for r in got] == [(0, 3)]


def test_pairs_above_a_threshold_are_found_without_trying_others():
    import numpy as np

    from twigmer.operators.sum_threshold import threshold_pairs

    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 300), (300, 40)):
        a, b = (np.round(rng.normal(-2, 1, x), 2) for x in (n, m))
        for eps in (-9.0, -4.0, -1.5, 3.0):
            i, j, score, tried = threshold_pairs(a, b, eps)
            want = {(x, y) for x in range(n) for y in range(m) if a[x] + b[y] > eps}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
            assert (score == a[i] + b[j]).all()
            assert tried - len(want) == sum(a[x] + b[y] <= eps < a[x] + b[y] + 1e-9 for x in range(n) for y in range(m))
    # at k = 8, the pairs that are tried are those that are found, of many more
    logp = np.log10(rng.dirichlet([0.4] * 4, 8))
    from twigmer.operators.sum_threshold import strings

    eps = scoring.log_threshold(1.5, 8, 4)
    left, right = strings(logp[:4], -99.0), strings(logp[4:], -99.0)
    i, _, _, tried = threshold_pairs(left[1], right[1], eps)
    assert tried == len(i) == len(strings(logp, eps)[0]) < len(left[0]) * len(right[0]) / 20


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_engines_are_equal_over_gaps_and_nodes(spark, k):
    rng = random.Random(k)
    rows = []
    for node in "uvw":
        for site in [s for s in range(30) if s not in (11, 12)]:
            p = [rng.random() ** 4 for _ in range(4)]
            rows.append((node, site, [x / sum(p) if x > 0.05 else 0.0 for x in p]))
    m = matrix(spark, rows)
    eps = scoring.log_threshold(1.3, k, 4)
    made = {e: {(r.node, r.position, r.code, round(r.score, 9)) for r in kmers.enumerate_kmers(m, k, 4, eps, e).collect()} for e in ("join", "sorted", "chained")}
    assert made["join"] == made["sorted"] == made["chained"] and made["join"]
    every = {(r.node, r.position, r.code, round(r.score, 9)) for r in kmers.enumerate_numpy(m, k, 4, eps, every=True).collect()}
    assert every == made["join"]


def test_halves_of_chained_windows_are_made_once(spark):
    rows = [(n, s, [0.7, 0.2, 0.1, 0.0]) for n in "ab" for s in range(20)]
    for k in (4, 5, 8):
        lists = kmers.half_lists(matrix(spark, rows), k, 4, scoring.log_threshold(1.2, k, 4)).collect()
        at = [(r.node, r.position) for r in lists]
        # a list for each place where a window begins or has its last half, and no second one
        assert sorted(at) == [(n, s) for n in "ab" for s in range(20 - k // 2 + 1)] and len(set(at)) == len(at)


def test_the_numpy_engine_keeps_the_best_of_a_block_within_a_bound(spark, monkeypatch):
    rows = [("v", s, [0.4, 0.3, 0.2, 0.1]) for s in range(64)]
    want = sorted(map(tuple, kmers.enumerate_numpy(matrix(spark, rows), 3, 4, -9.0).collect()))
    monkeypatch.setattr(kmers, "HELD", 100)
    got = sorted(map(tuple, kmers.enumerate_numpy(matrix(spark, rows), 3, 4, -9.0).collect()))
    assert got == want and len(got) == 64 and {r[1] for r in got} == {0}


def test_too_few_sites_and_empty_matrices_give_nothing(spark):
    for engine in kmers.ENGINES:
        for rows in (matrix(spark, F2), matrix(spark, F2).limit(0)):
            assert kmers.enumerate_kmers(rows, 4, 4, -9.0, engine).count() == 0


def test_score_at_the_threshold_is_left_out(spark):
    rows = matrix(spark, [("v", 0, [0.5, 0.5, 0.0, 0.0])])
    for engine in kmers.ENGINES:
        assert kmers.enumerate_kmers(rows, 1, 4, math.log10(0.5), engine).count() == 0


def test_best_and_position_of_ties(spark):
    found = spark.createDataFrame([("x1", 4, 7, -0.5), ("x0", 1, 7, -0.5), ("x1", 2, 7, -0.5), ("x0", 0, 7, -0.9)], "node string, position int, code long, score double")
    branches = spark.createDataFrame([("x1", 3, 0), ("x0", 3, 1)], "node string, branch int, node_order int")
    assert [tuple(r) for r in database.best_per_branch(found, branches, True).collect()] == [(3, 7, -0.5, 2)]


def test_filter_values_in_one_pass_equal_two(spark):
    best = spark.createDataFrame([(0, 1, -0.2), (1, 1, -0.5), (2, 1, 0.1), (0, 2, -1.0)], "branch int, code long, score double")
    thr, n = 0.01, 7
    for r in database.mif0(best, thr, n).collect():
        xs = [min(10**s, 1) for _, c, s in ((0, 1, -0.2), (1, 1, -0.5), (2, 1, 0.1), (0, 2, -1.0)) if c == r.code]
        total = sum(xs) + (n - len(xs)) * thr
        h = sum(-x / total * math.log2(x / total) for x in [*xs, *[thr] * (n - len(xs))])
        assert r.filter_value == pytest.approx(total * (h - math.log2(n)), abs=1e-12)


def test_random_filter_is_uniform_and_repeatable(spark):
    best = spark.range(2000).select(F.lit(0).alias("branch"), F.col("id").alias("code"), F.lit(0.0).alias("score"))
    a, b = ([r.filter_value for r in database.random_filter(best).orderBy("code").collect()] for _ in range(2))
    assert a == b
    assert abs(sum(a) / len(a) - 0.5) < 0.03


def test_global_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["rank"] == r.x for r in database.ranked(df, "x").collect())


@pytest.mark.parametrize(("text", "labels"), [(F1, ["A", "B", "AB", "C", "root"]), ("(A,(B[c],'D d':1e-2)x:2);", ["A", "B", "D d", "x", ""]), ("A;", ["A"])])
def test_newick(text, labels):
    nodes = tf.parse_newick(text)
    assert [n["label"] for n in sorted(nodes, key=lambda n: n["postorder"])] == labels


@given(st.recursive(st.just("x"), lambda s: st.lists(s, min_size=2, max_size=4), max_leaves=20))
@settings(max_examples=40, deadline=None)
def test_newick_round_trip(shape):
    count = itertools.count()

    def text(s):
        i = next(count)
        return f"n{i}:{i / 8}" if s == "x" else f"({','.join(map(text, s))})n{i}:{i / 8}"

    nodes = tf.parse_newick(text(shape) + ";")
    again = tf.parse_newick(tf.to_newick(nodes))
    nodes[0]["branch_length"] = again[0]["branch_length"] = 0.0
    assert nodes == again


def test_bad_newick():
    for text in ("(A,B;", "A,B;", "(A))B;"):
        with pytest.raises(ValueError):
            tf.parse_newick(text)


def test_ghosts_of_a_small_tree(spark):
    tree = bd.tree_table(spark, tf.parse_newick(F1))
    lengths = {r.label: (round(r.x0_length, 9), round(r.x1_length, 9)) for r in tr.ghost_lengths(tree).collect()}
    assert lengths == {"A": (0.1, 0.1), "B": (0.2, 0.2), "AB": (0.3, 0.6), "C": (0.5, 0.5)}
    extended = {r.label: r for r in tr.extend(tree).collect()}
    assert len(extended) == 5 + 16
    assert extended["A"].parent == "6_X0" and extended["6_X0"].parent == "AB" and extended["7_X1"].parent == "6_X0"
    assert extended["8_X2"].parent == "7_X1" and extended["18_X0"].parent == "root"
    mapping = {r.label: r.original for r in tr.ghost_mapping(tree).collect()}
    assert mapping == {f"{6 + 4 * r + i}_X{i}": r for r in range(4) for i in (0, 1)}
    order = [r.label for r in bd.ordered(spark, tr.extend(tree)).orderBy("postorder").collect()]
    assert order.index("7_X1") < order.index("A") < order.index("6_X0")


def test_orders_by_spark_equal_the_parser(spark):
    tree = bd.tree_table(spark, tf.parse_newick("(((a,b)c,d)e,(f,g,h)i)j;"))
    got = {r.label: (r.postorder, r.preorder) for r in tr.with_orders(tree.drop("postorder", "preorder")).collect()}
    assert got == {r.label: (r.postorder, r.preorder) for r in tree.collect()}


def test_reroot(spark):
    tree = bd.tree_table(spark, tf.parse_newick("(A:1,B:2,C:3)r;"))
    assert not tr.is_rooted(tree)
    assert bd.newick(tr.reroot(tree)) == "((B:2.0,C:3.0)r:0.0,A:1.0)added_root;"
    two = bd.tree_table(spark, tf.parse_newick("(A:1,B:2)r;"))
    assert bd.newick(tr.reroot(two)) == "(A:1.0,B:2.0)r;"


def test_map_nodes_needs_equal_sizes(spark):
    a, b = (bd.tree_table(spark, tf.parse_newick(t)) for t in ("(A,B)r;", "(A,(B,C)x)r;"))
    with pytest.raises(ValueError):
        tr.map_nodes(a, b)


def alignment(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_idx long, header string, seq string")


def test_gap_columns_at_the_ratio_go(spark):
    a = alignment(spark, ["A-CG", "A-C-", "A-C-", "A-C-"])
    assert [r.seq for r in al.drop_gap_columns(a, 0.75).orderBy("seq_idx").collect()] == ["AC"] * 4


def test_alignment_checks(spark):
    with pytest.raises(ValueError, match="s1"):
        al.check_lengths(alignment(spark, ["ACGT", "ACG"]))
    with pytest.raises(ValueError, match="empty"):
        al.check_lengths(alignment(spark, ["A"]).limit(0))


def test_unsupported_states(spark):
    assert [r.header for r in al.unsupported_states(alignment(spark, ["AC-t", "ACX-", "N"]), scoring.DNA).orderBy("seq_idx").collect()] == ["s1", "s2"]


@pytest.mark.parametrize("width", [1, 10, 11, 20])
def test_phylip(spark, tmp_path, width):
    seq = ("ACGTACGTAC" * 3)[:width]
    a = spark.createDataFrame([(0, "x" * 251, seq), (1, "y", seq)], "seq_idx long, header string, seq string")
    al.write_alignment(a, str(tmp_path / "p"), "phylip")
    lines = (tmp_path / "p").read_text().split("\n")
    blocks = " ".join(seq[i : i + 10] for i in range(0, width, 10))
    assert lines == [f"\t2\t{width}", "x" * 251 + blocks, "y" + " " * 249 + blocks, ""]


def test_fasta_round_trip(spark, tmp_path):
    a = alignment(spark, ["AC-T", "----", "GGGG"])
    al.write_alignment(a, str(tmp_path / "f"))
    assert [(r.header, r.seq) for r in tf.read_fasta(spark, str(tmp_path / "f")).orderBy("seq_idx").collect()] == [("s0", "AC-T"), ("s1", "----"), ("s2", "GGGG")]
    (tmp_path / "m.fasta").write_text(">a b\nAC\nGT\n\n>c\r\nTT--\r\n")
    assert [(r.header, r.seq) for r in tf.read_fasta(spark, str(tmp_path / "m.fasta")).collect()] == [("a b", "ACGT"), ("c", "TT--")]


def test_amino_columns_are_put_into_code_order(spark, tmp_path):
    cols = [f"p_{c}" for c in scoring.AMINO_FILE_ORDER]
    values = ["1" if c == "K" else "0" for c in scoring.AMINO_FILE_ORDER]
    (tmp_path / "t.tsv").write_text("\t".join(["Node", "Site", "State", *cols]) + "\n.comment\n\n" + "\t".join(["n", "1", "K", *values]) + "\n")
    r = tf.read_ar_table(spark, str(tmp_path / "t.tsv"), "amino").collect()
    assert len(r) == 1
    assert r[0].logp.index(0.0) == scoring.AMINO.index("K")


def test_hazen_quantile(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert [df.select(scoring.hazen_quantile(F.col("v"), p)).first()[0] for p in (0.0, 0.25, 0.5, 1.0)] == [1.0, 1.5, 2.5, 4.0]


def test_long_codes_decode(spark):
    for k, alphabet in ((31, scoring.DNA), (14, scoring.AMINO)):
        code = sum((len(alphabet) - 1) * len(alphabet) ** i for i in range(k))
        assert spark.range(1).select(scoring.decode(F.lit(code), k, alphabet)).first()[0] == alphabet[-1] * k


def test_database_diff(spark):
    a = spark.createDataFrame([(1, 0, -0.5), (2, 0, -0.5), (3, 0, -0.5)], "code long, branch int, score double")
    b = spark.createDataFrame([(1, 0, -0.505), (2, 0, -0.52), (4, 0, -0.5)], "code long, branch int, score double")
    assert compare.database_diff(a, a).count() == 0
    assert sorted((r.code, r.kind) for r in compare.database_diff(a, b).collect()) == [(2, "score"), (3, "only_a"), (4, "only_b")]


def test_text_diff_is_one_sided(spark):
    a = spark.createDataFrame([("AA", 1, 0.5), ("AC", 1, 0.2)], "kmer string, branch int, score double")
    b = spark.createDataFrame([("AA", 1, 0.6), ("AA", 2, 0.7), ("GG", 1, 0.9), ("AC", 1, 0.2005)], "kmer string, branch int, score double")
    assert sorted((r.kmer, r.branch) for r in compare.text_diff(a, b, 0.1).collect()) == [("AA", 1), ("AA", 2)]


def test_parameters_are_checked():
    for bad in ({"k": 32}, {"states": "rna"}, {"states": "amino", "k": 15}, {"omega": 4.0}, {"ghosts": "none"}, {"filter": "x"}, {"mu": 0}, {"model": "LG"}):
        with pytest.raises(ValueError):
            BuildParams(**bad)


def test_reconstruction_calls(spark, tmp_path):
    p = BuildParams(model="GTR")
    assert "GTR+G4{1.0}+IU{0}+FC" in rc.command("raxml-ng", "/b", "a", "t", p)
    assert rc.command("raxml-ng", "/b", "a", "t", p, arguments=["--x", "1"])[-2:] == ["--x", "1"]
    assert rc.guess_tool("usage\nRAxML-NG v. 1") == "raxml-ng"
    with pytest.raises(ValueError):
        rc.guess_tool("nothing")
    with pytest.raises(FileNotFoundError):
        rc.find_outputs(spark, str(tmp_path))
    (tmp_path / "c.json").write_text(json.dumps({"arguments": {"model": "GTR", "redo": ""}}))
    assert tf.read_config(str(tmp_path / "c.json")) == ["--model", "GTR", "--redo"]


def _write_inputs(tmp_path, spark):
    """A three-leaf tree, its alignment, and results of a reconstruction with made-up probabilities."""
    (tmp_path / "tree.nwk").write_text(F1)
    (tmp_path / "a.fasta").write_text(">A\nACGTA\n>B\nACGTC\n>C\nACTTC\n")
    tree = bd.tree_table(spark, tf.parse_newick(F1))
    ext = bd.ordered(spark, tr.extend(tree))
    (tmp_path / "ar").mkdir()
    ar_rows = [(f"a{r.postorder}", None if r.parent is None else r.parent, r) for r in ext.orderBy("postorder").collect()]
    name = {r.label: n for n, _, r in ar_rows}
    renamed = spark.createDataFrame([(n, name.get(p), r.branch_length, r.child_ord) for n, p, r in ar_rows], "label string, parent string, branch_length double, child_ord long")
    (tmp_path / "ar" / "x.raxml.ancestralTree").write_text(bd.newick(renamed))
    lines = ["Node\tSite\tState\tp_A\tp_C\tp_G\tp_T"]
    probs = {}
    for i, (n, _, _) in enumerate(ar_rows):
        for s in range(1, 6):
            w = [1 + (i * 7 + s * 3 + c * 5) % 11 for c in range(4)]
            probs[n, s] = [round(x / sum(w), 6) for x in w]
            lines.append("\t".join([n, str(s), "A", *map(str, probs[n, s])]))
    (tmp_path / "ar" / "x.raxml.ancestralProbs").write_text("\n".join(lines) + "\n")
    return ar_rows, probs


@pytest.mark.parametrize("ghosts", ["both", "inner-only"])
def test_build_from_files(spark, tmp_path, ghosts):
    ar_rows, probs = _write_inputs(tmp_path, spark)
    params = BuildParams(k=3, omega=1.2, ghosts=ghosts, engine="numpy")
    path = bd.build(spark, str(tmp_path / "a.fasta"), str(tmp_path / "tree.nwk"), str(tmp_path / "w"), params, ar_dir=str(tmp_path / "ar"))
    rows, header = database.read_database(spark, path)
    suffixes = ("_X0", "_X1") if ghosts == "both" else ("_X0",)
    branch_of = {n: (int(r.label.split("_")[0]) - 6) // 4 for n, _, r in ar_rows if r.label.endswith(suffixes)}
    want = {}
    found = brute([(n, s, p) for (n, s), p in probs.items() if n in branch_of], 3, 4, params.log_threshold)
    for n, _, code, score in found:
        key = (branch_of[n], code)
        want[key] = max(want.get(key, -99), score)
    got = {(r.branch, r.code): round(r.score, 8) for r in database.flat(rows).collect()}
    assert got == pytest.approx(want)
    h = header.first()
    assert (h.k, h.num_entries, h.num_kmers, len(h.tree_index)) == (3, len(want), len({c for _, c in want}), 5)
    values = [r.filter_value for r in spark.read.parquet(f"{path}/postings").collect()]
    assert len(values) == h.num_kmers
    head, diff = bd.diff_databases(spark, path, path)
    assert diff.count() == 0 and head.where("not same").count() == 0
    dump = bd.dump_database(spark, path)
    compare.dump_text(dump).write.text(str(tmp_path / "dump"))
    back = tf.read_dump(spark, str(tmp_path / "dump"))
    assert back.count() == len(want)
    assert compare.text_diff(dump, back, params.threshold).count() == 0


def test_build_by_uris_with_a_tool(spark, tmp_path):
    """All paths as URIs; a stub in place of the reconstruction tool checks its inputs and gives the results of an earlier run."""
    _write_inputs(tmp_path, spark)
    tool = tmp_path / "tool"
    tool.write_text(
        f"""#!/bin/sh
[ "$1" = --help ] && echo "RAxML-NG v. 1" && exit
while [ $# -gt 0 ]; do [ "$1" = --msa ] && msa="$2"; [ "$1" = --tree ] && tree="$2"; shift; done
grep -q "^	11	5$" "$msa" && grep -q "_X0:" "$tree" || exit 3
for end in ancestralProbs ancestralTree; do cp "{tmp_path}/ar/x.raxml.$end" "$msa.raxml.$end"; done
"""
    )
    tool.chmod(0o755)
    uri = f"file://{tmp_path}"
    params = BuildParams(k=3, omega=1.2)
    made = bd.build(spark, f"{uri}/a.fasta", f"{uri}/tree.nwk", f"{uri}/w/", params, ar_binary=str(tool))
    plain = bd.build(spark, str(tmp_path / "a.fasta"), str(tmp_path / "tree.nwk"), str(tmp_path / "v"), params, ar_dir=str(tmp_path / "ar"))
    assert made == f"{uri}/w/DB"
    head, rows = bd.diff_databases(spark, made, plain)
    assert rows.count() == 0 and head.where("not same").count() == 0
    fasta = (tmp_path / "w/extended_trees/extended_align.fasta").read_text()
    assert fasta.startswith(">A\nACGTA\n>B\nACGTC\n>C\nACTTC\n>") and fasta.count(">") == 11
    assert (tmp_path / "w/align.reduced.fasta").read_text() == ">A\nACGTA\n>B\nACGTC\n>C\nACTTC\n"
    assert (tmp_path / "w/AR/extended_align.phylip.raxml.ancestralProbs").is_file()
    tree = tf.parse_newick((tmp_path / "w/extended_trees/extended_tree.newick").read_text())
    assert sum(n["is_leaf"] for n in tree) == 3 + 16 // 2 and len(tree) == 5 + 16


def test_command_line(spark, tmp_path, capsys):
    _write_inputs(tmp_path, spark)
    files = ["-r", str(tmp_path / "a.fasta"), "-t", str(tmp_path / "tree.nwk"), "--ar-dir", str(tmp_path / "ar"), "-k", "3"]
    for name, omega in (("x", "1.2"), ("y", "1.3")):
        assert bd.main(["build", *files, "-w", str(tmp_path / name), "--omega", omega, "--on-disk", "--engine", "hof"]) == 0
    x, y = (str(tmp_path / n / "DB") for n in "xy")
    capsys.readouterr()
    assert bd.main(["diff", x, x]) == 0
    assert bd.main(["diff", x, y, "-v"]) == 1
    assert "DIFF omega" in capsys.readouterr().out
    assert bd.main(["dump", x]) == 0
    assert "\t" in capsys.readouterr().out


def test_raising_omega_keeps_a_subset(spark, tmp_path):
    rows = matrix(spark, F2)
    low, high = ({(r.position, r.code) for r in kmers.enumerate_hof(rows, 2, 4, scoring.log_threshold(o, 2, 4)).collect()} for o in (0.5, 1.6))
    assert high < low


def test_unrooted_trees_are_refused(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(A,B,C)r;")
    with pytest.raises(ValueError, match="rooted"):
        bd.build(spark, "x", str(tmp_path / "t.nwk"), str(tmp_path), BuildParams())


def test_streamed_best_scores(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, -0.5), (0, 1, -0.2), (1, 1, -0.7)], "branch int, code long, score double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = best_scores(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("best_scores").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("best_scores").collect())) == [(0, 1, -0.2), (1, 1, -0.7)]


def test_phyml_tables(spark, tmp_path):
    head = "Some 1 x 2 3 4 5\nSiteless\n\nSite\tNodeLabel\tA\tC\tG\tT\tMPEE\n"
    head = head.replace("Siteless", "A Site here")
    (tmp_path / "t.txt").write_text(head + "".join(f" {s}   n{i}\t0.5 0.25\t0.25   0.0 A\r\n" for i in range(300) for s in range(1, 4)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("2000", "1"), strict=True):
        spark.conf.set(k, v)
    try:
        got = tf.read_phyml(spark, str(tmp_path / "t.txt")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.node, r.site) for r in got) == sorted((f"n{i}", s) for i in range(300) for s in range(1, 4))
    assert all(r.logp == [math.log10(0.5), math.log10(0.25), math.log10(0.25), float("-inf")] for r in got)
    for name, text, match in (("bad", head + "1 n 0.5 0.5\n", "not a line"), ("none", "1 n 1 0 0 0\n", "no table")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=match):
            tf.read_phyml(spark, str(tmp_path / name)).collect()
    with pytest.raises(NotImplementedError):
        tf.READERS["phyml"](spark, str(tmp_path / "t.txt"), "amino")


def test_subtree_sums_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("n0", None, 0.0, 0)] + [(f"n{i}", f"n{rng.randrange(max(0, i - 4), i)}", rng.randrange(1, 99) / 8, rng.randrange(3)) for i in range(1, 120)]
    tree = spark.createDataFrame(rows, "label string, parent string, branch_length double, child_ord long")
    children = {r[0]: sorted((x[3], x[0]) for x in rows if x[1] == r[0]) for r in rows}
    length, pre, post, want = {r[0]: r[2] for r in rows}, [], [], {}

    def walk(v):
        pre.append(v)
        below = [walk(c) for _, c in children[v]]
        post.append(v)
        leaves = sum(b[0] for b in below) or 1
        want[v] = (leaves, 1 + sum(b[1] for b in below), sum(b[2] + length[c] for b, (_, c) in zip(below, children[v], strict=True)), sum(b[3] + b[0] * length[c] for b, (_, c) in zip(below, children[v], strict=True)))
        return want[v]

    walk("n0")
    ordered = tr.with_orders(tree)
    assert {r.label: (r.preorder, r.postorder) for r in ordered.collect()} == {v: (pre.index(v), post.index(v)) for v in want}
    for t in (tree, ordered.drop("child_ord")):
        got = {r.label: (r.n_leaves, r.n_nodes, r.subtree_length, r.leaf_distance) for r in tr.subtree_stats(t).collect()}
        assert got == want  # eighths add up exactly


def test_a_deep_comb(spark):
    depth = 2000
    rows = [("n0", None, 0.0)] + [x for i in range(1, depth) for x in ((f"n{i}", f"n{i - 1}", 1.0), (f"l{i}", f"n{i - 1}", 1.0))]
    tree = spark.createDataFrame(rows, "label string, parent string, branch_length double")
    top = {r.label: r for r in tr.subtree_stats(tree).where("label in ('n0', 'n1', 'l1')").collect()}
    assert top["n0"].n_nodes == 2 * depth - 1 and top["n0"].n_leaves == depth and top["n0"].subtree_length == 2 * depth - 2
    assert top["l1"].n_nodes == 1 and top["n1"].n_nodes == 2 * depth - 3 and top["l1"].leaf_distance == 0


def test_a_tree_in_a_circle(spark):
    with pytest.raises(ValueError):
        tr.subtree_stats(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "label string, parent string, branch_length double"))
