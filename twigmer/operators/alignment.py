"""Alignments: ``(seq_idx long, header, seq)``, all sequences of one width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twigmer.functions.scoring import GAP
from twigmer.sources.storage import write_file

LABEL_WIDTH, PHYLIP_BLOCK = 250, 10


def bad_lengths(alignment: DataFrame) -> DataFrame:
    """The rows whose width isn't that of the first sequence."""
    first = alignment.agg(F.min_by(F.length("seq"), "seq_idx").alias("width"))
    return alignment.join(F.broadcast(first)).where(F.length("seq") != F.col("width"))  # one row


def check_lengths(alignment: DataFrame) -> int:
    """The width; raises if sequences differ in it, or if there are none."""
    width = alignment.agg(F.min_by(F.length("seq"), "seq_idx")).first()[0]
    if width is None:
        raise ValueError("the alignment is empty")
    for r in bad_lengths(alignment).limit(1).collect():
        raise ValueError(f"sequence {r.header} has {len(r.seq)} characters, the first has {width}")
    return width


def unsupported_states(alignment: DataFrame, alphabet: str) -> DataFrame:
    """The rows with other characters than states (in either case) and gaps."""
    return alignment.where(F.upper("seq").rlike(f"[^{alphabet}\\{GAP}]"))


def _count_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(site, gaps, n)`` of the rows of a partition: one row a column, counted over blocks of characters."""
    gaps, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        rows = batch.column("seq").drop_null()
        if not len(rows):
            continue
        widths = pc.utf8_length(rows).to_numpy()
        for width in np.unique(widths):
            same = rows.filter(pa.array(widths == width)).to_pylist()
            chars = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(len(same), width)
            gaps, n = (np.pad(x, (0, max(0, width - len(x)))) for x in (gaps, n))
            gaps[:width] += (chars == ord(GAP)).sum(axis=0)
            n[:width] += len(same)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(gaps), pa.array(n)], ["site", "gaps", "n"])


def gap_ratios(alignment: DataFrame) -> DataFrame:
    """``(site, ratio)``: the share of gaps in each column, sites from 0. Partitions count their columns; only counts are shuffled."""
    counted = alignment.select("seq").mapInArrow(_count_gaps, "site int, gaps long, n long")
    return counted.groupBy("site").agg((F.sum("gaps") / F.sum("n")).alias("ratio"))


def drop_gap_columns(alignment: DataFrame, ratio: float = 0.99) -> DataFrame:
    """The alignment without the columns whose gap ratio is ``ratio`` or more."""
    kept = gap_ratios(alignment).where(F.col("ratio") < ratio).agg(F.sort_array(F.collect_list("site")).alias("sites"))  # the width at most
    # runs of kept columns: each row is a few substrings
    begins = F.filter("sites", lambda s, i: (i == 0) | (F.get("sites", i - 1) != s - 1))
    ends = F.filter("sites", lambda s, i: (i == F.size("sites") - 1) | (F.get("sites", i + 1) != s + 1))
    runs = kept.select(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("begin"), (b - a + 1).alias("n"))).alias("runs"))
    rows = alignment.join(F.broadcast(runs))  # one row
    seq = F.array_join(F.transform("runs", lambda r: F.substring(F.col("seq"), r["begin"] + 1, r["n"])), "")
    return rows.withColumn("seq", F.when(F.col("seq").isNotNull(), seq)).drop("runs")


def extend_alignment(alignment: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(header, seq)``: the alignment and a row of gaps for each leaf ``(label)`` it lacks."""
    width = alignment.agg(F.max(F.length("seq")).alias("width"))
    new = leaves.select(F.col("label").alias("header")).join(alignment.select("header"), "header", "left_anti")
    gaps = new.join(F.broadcast(width)).select("header", F.repeat(F.lit(GAP), F.col("width")).alias("seq"))
    return alignment.select("header", "seq").unionByName(gaps)


def fasta_lines(alignment: DataFrame) -> DataFrame:
    return alignment.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"))


def phylip_header(alignment: DataFrame) -> DataFrame:
    n, width = F.count(F.lit(1)), F.min_by(F.length("seq"), "seq_idx")
    return alignment.agg(F.concat(F.lit("\t"), n.cast("string"), F.lit("\t"), width.cast("string")).alias("value"))


def phylip_lines(alignment: DataFrame) -> DataFrame:
    """Labels filled up to 250 characters (longer ones stay whole), sequences in blocks of 10."""
    return alignment.select("header", _phylip_line().alias("value"))


def _phylip_line() -> Column:
    label = F.rpad("header", F.greatest(F.length("header"), F.lit(LABEL_WIDTH)), F.lit(" "))
    return F.concat(label, F.regexp_replace("seq", f"(.{{{PHYLIP_BLOCK}}})(?=.)", "$1 "))


def file_lines(alignment: DataFrame, kind: str = "fasta") -> DataFrame:
    """``(value)``: the lines of one FASTA or PHYLIP text in the order of ``seq_idx``, in one partition: a format of one file."""
    rows = alignment.repartitionByRange(1, "seq_idx").sortWithinPartitions("seq_idx")
    if kind == "fasta":
        return fasta_lines(rows)
    if kind != "phylip":
        raise ValueError(f"unknown alignment format {kind!r}")
    head = phylip_header(alignment).withColumn("at", F.lit(-1).cast("long"))
    body = alignment.select(_phylip_line().alias("value"), F.col("seq_idx").alias("at"))
    return head.unionByName(body).repartitionByRange(1, "at").sortWithinPartitions("at").select("value")


def write_alignment(alignment: DataFrame, path: str, kind: str = "fasta") -> None:
    """Write :func:`file_lines` as one file, on whatever file system the path names."""
    write_file(file_lines(alignment, kind), path)


def to_canonical_amino(alignment: DataFrame) -> DataFrame:
    """U and O as C and L."""
    return alignment.withColumn("seq", F.translate("seq", "UOuo", "CLcl"))
