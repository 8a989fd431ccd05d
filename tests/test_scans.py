"""Scans over split files: dumps with a carry, FASTA, reconstruction tables by blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from twigmer.sources import ar_blocks
from twigmer.sources import text_formats as tf


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def python_dump(text):
    """Entries by line, as a plain program reads them."""
    out, kmer = [], None
    for line in text.split("\n")[:-1]:
        line = line.strip()
        if "\t" not in line:
            kmer = line
        else:
            score, branch = line.split("\t")
            out.append((kmer, int(branch), float(score)))
    return out


def test_dump_lines_are_filled_forward_across_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    files = []
    for f in range(3):
        lines = []
        for i in range(40):
            lines.append(f"KMER{f}_{i}" + rng.choice(["", "\r", "  "]))
            lines += [f"\t{rng.random():.6f}\t{b}" for b in range(rng.choice([0, 1, 3, 120]))]  # 120 lines cover several splits
        files.append("\n".join(lines) + "\n")
    files.append("\t0.5\t7\n\t0.25\t8\nLATE\n\t0.125\t9\n")  # entries before the first name
    for i, text in enumerate(files):
        (tmp_path / f"d{i}.txt").write_bytes(text.encode())
    df = tf.read_dump(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    plan = df._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower()
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted((e for t in files for e in python_dump(t)), key=str)
    assert (None, 7, 0.5) in got


def test_empty_and_bad_dumps(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert tf.read_dump(spark, str(tmp_path / "empty.txt")).count() == 0
    (tmp_path / "bad.txt").write_text("A\n\tx\t1\n")
    with pytest.raises(Exception, match="(?i)invalid|failed to parse"):
        tf.read_dump(spark, str(tmp_path / "bad.txt")).collect()


def test_fasta_records_begin_at_lines(spark, tmp_path, small_splits):
    text = ">x a>b c\nAC>GT\n-A\n" + "".join(f">n{i} p>q\r\n{'ACGT' * (i % 40)}\r\n{'-' * (i % 7)}\r\n" for i in range(60)) + ">last\n"
    (tmp_path / "a.fasta").write_bytes(text.encode())
    got = [(r.header, r.seq) for r in tf.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("seq_idx").collect()]
    assert got == [("x a>b c", "AC>GT-A"), *((f"n{i} p>q", "ACGT" * (i % 40) + "-" * (i % 7)) for i in range(60)), ("last", "")]


HEADER = "Node\tSite\tState\tp_A\tp_C\tp_G\tp_T\n"


def table(blocks):
    """Blocks ``(node, first probability)`` of five lines."""
    return HEADER + "".join(f"{node}\t{s}\tA\t{p}\t{1 - p}\t 0.0\t0\n" for node, p in blocks for s in range(1, 6))


@pytest.mark.parametrize("range_bytes", [50, 333, 1 << 20])
def test_blocks_of_nodes(spark, tmp_path, range_bytes):
    blocks = [(f"n{i}", (i + 1) / 64) for i in range(40)] + [("n3", 0.75), ("n39x", 0.5)]
    (tmp_path / "t.tsv").write_text(table(blocks).replace("n5\t3", ".a comment\n\nn5\t3"))
    path, index = str(tmp_path / "t.tsv"), str(tmp_path / "index")
    ar_blocks.index_blocks(spark, path, index, range_bytes)
    places = {r.node: (r.begin, r.end) for r in spark.read.parquet(index).collect()}
    raw = (tmp_path / "t.tsv").read_bytes()
    assert len(places) == 41
    assert raw[slice(*places["n7"])].decode() == table([("n7", 8 / 64)])[len(HEADER) :]
    df = ar_blocks.read_blocks(spark, path, index=index, range_bytes=range_bytes)
    got = {(r.node, r.site): r.logp for r in df.collect()}
    want = {(node, s): [math.log10(p), math.log10(1 - p)] for node, p in dict(blocks).items() for s in range(1, 6)}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and abs(got[k][1] - want[k][1]) < 1e-12 and got[k][2] == float("-inf") for k in want)
    assert abs(got[("n3", 1)][0] - math.log10(0.75)) < 1e-12  # the later block of a node counts


def test_other_blocks_are_not_read(spark, tmp_path):
    path, index = tmp_path / "t.tsv", str(tmp_path / "index")
    path.write_text(table([(f"n{i}", 0.5) for i in range(30)]))
    ar_blocks.index_blocks(spark, str(path), index)
    begin, end = next((r.begin, r.end) for r in spark.read.parquet(index).where("node = 'n11'").collect())
    raw = path.read_bytes()
    path.write_bytes(b"\xff" * begin + raw[begin:end] + b"\xff" * (len(raw) - end))  # what isn't text can't be read
    df = ar_blocks.read_blocks(spark, str(path), index=index)
    assert [r.site for r in df.where("node = 'n11'").orderBy("site").collect()] == [1, 2, 3, 4, 5]
    assert df.where(F.col("node").isin("n11")).rdd.getNumPartitions() == 1
    assert df.where("node = 'n11' and node = 'n12'").count() == 0
    with pytest.raises(Exception, match="n30"):
        df.where(F.col("node").isin("n11", "n30")).collect()
    with pytest.raises(Exception, match="(?i)utf|parse error"):
        df.where("node = 'n12'").collect()


def test_tables_of_several_files_and_amino_acids(spark, tmp_path):
    from twigmer.functions.scoring import AMINO, AMINO_FILE_ORDER

    for f in range(3):
        lines = ["Node\tSite\tState\t" + "\t".join(f"p_{c}" for c in AMINO_FILE_ORDER)]
        lines += [f"v{f}\t{s}\t-\t" + "\t".join(str((AMINO_FILE_ORDER.index(c) + 1 + f) / 300) for c in AMINO_FILE_ORDER) for s in range(3)]
        (tmp_path / f"part-{f}").write_text("\n".join(lines) + "\n" * (f != 2))  # the last line may lack its end
    (tmp_path / "_SUCCESS").write_text("")
    rows = ar_blocks.read_blocks(spark, f"file://{tmp_path}", states="amino").collect()
    assert sorted((r.node, r.site) for r in rows) == [(f"v{f}", s) for f in range(3) for s in range(3)]
    want = [(AMINO_FILE_ORDER.index(c) + 1) / 300 for c in AMINO]
    assert all(abs(10**x - y) < 1e-12 for x, y in zip(next(r.logp for r in rows if r.node == "v0"), want, strict=True))
