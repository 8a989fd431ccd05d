"""Text inputs: FASTA, Newick, reconstruction tables, dumps, configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twigmer.functions.scoring import ALPHABETS, AMINO_FILE_ORDER, DNA, log_probability

NODE_SCHEMA = "tree_id string, label string, parent_pos long, branch_length double, postorder long, preorder long, child_ord long, is_leaf boolean"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_idx, header, seq)``; gaps stay, lines of a sequence are joined. Order is that of files and places in them.

    A record begins with a ``>`` at the start of a line; another one inside the header is part of it, those that open it
    aren't. Files are split between records; each has to begin with one.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.btrim("value", F.lit(" \t\r\n>")) != "")
    # only a file's first record still has its sign
    parts = F.split(F.regexp_replace("value", r"^\s*>+", ""), "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", "")
    return raw.select(F.monotonically_increasing_id().alias("seq_idx"), F.regexp_replace(parts[0], "\r$", "").alias("header"), seq.alias("seq"))


def parse_newick(text: str) -> list[dict]:
    """The nodes of one tree with their orders from 0; ``parent_pos`` is the parent's postorder. Quoted labels, comments in []."""
    text = text.strip().rstrip(";")
    nodes: list[dict] = []

    def fresh(parent: int | None) -> int:
        nodes.append({"label": "", "parent": parent, "branch_length": 0.0, "children": [], "preorder": len(nodes)})
        if parent is not None:
            nodes[parent]["children"].append(len(nodes) - 1)
        return len(nodes) - 1

    at, i = fresh(None), 0
    while i < len(text):
        c = text[i]
        if c == "(":
            at = fresh(at)
        elif c == ",":
            if nodes[at]["parent"] is None:
                raise ValueError("comma outside of parentheses")
            at = fresh(nodes[at]["parent"])
        elif c == ")":
            at = nodes[at]["parent"]
            if at is None:
                raise ValueError("unbalanced parentheses")
        elif c == "[":
            i = text.index("]", i)
        elif not c.isspace():
            j = i
            if c == "'":
                j = text.index("'", i + 1) + 1
                nodes[at]["label"] = text[i + 1 : j - 1]
            else:
                while j < len(text) and text[j] not in "(),[":
                    j += 1
                label, _, length = text[i:j].partition(":")
                nodes[at]["label"] = nodes[at]["label"] or label.strip()
                if length.strip():
                    nodes[at]["branch_length"] = float(length)
            i = j - 1
        i += 1
    if nodes[at]["parent"] is not None:
        raise ValueError("unbalanced parentheses")
    rank, stack = 0, [(0, False)]
    while stack:
        n, done = stack.pop()
        if done:
            nodes[n]["postorder"] = rank
            rank += 1
        else:
            stack += [(n, True), *((c, False) for c in reversed(nodes[n]["children"]))]
    for n in nodes:
        for k, c in enumerate(n["children"]):
            nodes[c]["child_ord"] = k
    return [
        {
            "label": n["label"],
            "parent_pos": None if n["parent"] is None else nodes[n["parent"]]["postorder"],
            "branch_length": n["branch_length"],
            "postorder": n["postorder"],
            "preorder": n["preorder"],
            "child_ord": n.get("child_ord", 0),
            "is_leaf": not n["children"],
        }
        for n in nodes
    ]


def read_newick(trees: DataFrame) -> DataFrame:
    """``trees(tree_id, newick)`` -> their nodes; one text is one tree, trees are parsed in parallel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
        for frame in frames:
            for tree_id, text in zip(frame["tree_id"], frame["newick"], strict=True):
                rows = pd.DataFrame(parse_newick(text)).assign(tree_id=tree_id)
                yield rows.astype({"parent_pos": "Int64"})[names]

    return trees.select(F.col("tree_id").cast("string"), "newick").mapInPandas(run, NODE_SCHEMA)


def to_newick(nodes: list[dict]) -> str:
    """The text of one tree of :func:`parse_newick`'s nodes."""
    children: dict = {}
    for n in sorted(nodes, key=lambda n: n["child_ord"]):
        children.setdefault(n["parent_pos"], []).append(n)
    made: dict[int, str] = {}
    for n in sorted(nodes, key=lambda n: n["postorder"]):
        own = [made[c["postorder"]] for c in children.get(n["postorder"], [])]
        length = "" if n["parent_pos"] is None else f":{n['branch_length']!r}"
        made[n["postorder"]] = (f"({','.join(own)})" if own else "") + n["label"] + length
    return made[children[None][0]["postorder"]] + ";"


def read_ar_table(spark: SparkSession, path: str, states: str = "nucl") -> DataFrame:
    """``(node, site, logp)`` of a reconstruction's tab-separated table: Node, Site, State and a column for each state.

    Lines that start with a dot are comments; amino acids are put into code order.
    """
    order = DNA if states == "nucl" else AMINO_FILE_ORDER
    schema = ", ".join(["Node string", "Site int", "State string", *(f"p_{c} double" for c in order)])
    raw = spark.read.csv(path, sep="\t", header=True, comment=".", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    logp = F.array(*[log_probability(F.col(f"p_{c}")) for c in ALPHABETS[states]])
    return raw.where("Node is not null").select(F.col("Node").alias("node"), F.col("Site").alias("site"), logp.alias("logp"))


def read_phyml(spark: SparkSession, path: str, states: str = "nucl") -> DataFrame:
    """``(node, site, logp)`` of PhyML's posterior tables: what comes after a file's line that starts with ``Site``, parted by blanks.

    Each line has a site, a node and a probability for each nucleotide; further columns don't count. Splits are read in
    parallel, one place a file says where its table begins. Lines that don't fit raise, as do files without a table and amino acids.
    """
    if states != "nucl":
        raise NotImplementedError("posterior files of PhyML for amino acids aren't supported")
    at = F.struct(F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    head = lines.where(F.col("value").startswith("Site") & (F.length("value") > 4)).groupBy("file").agg(F.min("at").alias("head"))
    parts = F.split(F.btrim("value", F.lit(" \t\r")), r"\s+")
    start = F.when(F.col("head").isNotNull(), F.col("head")).otherwise(F.raise_error(F.concat(F.lit("no table in "), F.col("file"))))
    after = F.col("at") > start  # inside, too: what a later explode asks of the lines may be asked before the filter
    fits = F.when(~after, F.lit(None)).when(F.size(parts) >= 2 + len(DNA), parts).otherwise(F.raise_error(F.concat(F.lit("not a line of a posterior table: "), F.col("value"))))
    rows = lines.join(head, "file", "left").where(after & (F.btrim("value", F.lit(" \t\r")) != ""))
    logp = F.array(*[log_probability(F.col("p")[2 + i].cast("double")) for i in range(len(DNA))])
    return rows.select(fits.alias("p")).select(F.col("p")[1].alias("node"), F.col("p")[0].cast("int").alias("site"), logp.alias("logp"))


READERS = {"raxml-ng": read_ar_table, "phyml": read_phyml}


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits -> entries, each with the last k-mer named before it in its split (null where there is none)."""
    split, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        splits, lines = batch.column("split").to_numpy(), pc.utf8_trim_whitespace(batch.column("value"))
        is_entry = pc.match_substring(lines, "\t").to_numpy(zero_copy_only=False)
        place = np.arange(batch.num_rows)
        begins = np.maximum.accumulate(np.where(np.r_[splits[0] != split, np.diff(splits) != 0], place, -1))
        names = np.maximum.accumulate(np.where(is_entry, -1, place))
        own = names >= np.maximum(begins, 0)  # else the name stands in an earlier batch, or in an earlier split
        kmers = pc.if_else(pa.array(own), lines.take(pa.array(np.maximum(names, 0))), pc.if_else(pa.array(begins < 0), pa.scalar(last, pa.string()), pa.scalar(None, pa.string())))
        split, last = splits[-1], kmers[-1].as_py()
        entries = pa.array(is_entry)
        parts = pc.split_pattern(lines.filter(entries), "\t", max_splits=1)
        score, branch = (pc.utf8_trim_whitespace(pc.list_element(parts, i)) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("split").filter(entries), kmers.filter(entries), branch.cast(pa.int32()), score.cast(pa.float64())], ["split", "kmer", "branch", "score"])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(kmer, branch, score)`` of dump text: a line without a tab names the k-mer of the lines after it, whatever split of the file they are in.

    Splits are read in parallel and filled forward inside. What a split's first lines belong to comes from the last
    name in each split, one row a split, carried along the file. Lines before a file's first name have no k-mer (null);
    names carry from no file to another. An entry that isn't a score, a tab and a branch raises.
    """
    at = ["file", "begin"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"))
    blank = F.lit(" \t\r\n\x0b\x0c")
    name = F.btrim("value", blank)
    named = F.when(~F.contains(name, F.lit("\t")), F.col("row"))
    ends = lines.groupBy(*at).agg(F.max_by(name, named).alias("last"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    split = F.xxhash64(*at)
    carried = ends.select(split.alias("split"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    rows = lines.select(split.alias("split"), "value").mapInArrow(_filled, "split long, kmer string, branch int, score double")
    return rows.join(carried, "split", "left").select(F.coalesce("kmer", "carried").alias("kmer"), "branch", "score")


def read_config(path: str) -> list[str]:
    """The arguments of a JSON configuration, as ``--name value`` parts; the key ``arguments`` is required."""
    with open(path) as f:
        arguments = json.load(f)["arguments"]
    return [x for name, value in arguments.items() for x in (f"--{name}", *([] if value in (None, "") else [str(value)]))]
