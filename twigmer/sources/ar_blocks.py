"""Tables of ancestral probabilities as a Spark data source that reads the blocks of the nodes asked for.

A table is tab-separated text: a first line of names, then ``Node, Site, State`` and a probability for each state; the
lines of a node are a block. An index, made by one scan in byte ranges, has the place of each node's block. Filters on
the node are pushed down to it: other byte ranges aren't opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from twigmer.functions.scoring import ALPHABETS, AMINO_FILE_ORDER, DNA, log_probability
from twigmer.sources.shared import new_path

#: Bytes of a partition: longer files are cut, neighbouring blocks are read together.
RANGE_BYTES = 16 << 20
FILE_ORDER = {"nucl": DNA, "amino": AMINO_FILE_ORDER}


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and its path there."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return pyarrow.fs.FileSystem.from_uri(path)


def data_files(path: str) -> list[tuple[str, int]]:
    """The files of a table and their sizes; names that begin with a dot or an underscore aren't data."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if f.is_file]
    return sorted((f.path, f.size) for f in found if f.size and f.base_name[0] not in "._")


@dataclass
class Bytes(InputPartition):
    """``[begin, end)`` of a file of the table."""

    file: str
    begin: int
    end: int


def lines_from(handle, begin: int, end: int, size: int) -> tuple[int, bytes]:
    """Where the first line that starts in ``[begin, end)`` starts, and the bytes from there to the end of the last such line."""
    at = max(begin - 1, 0)
    handle.seek(at)
    data = handle.read(end - at)
    while data and not data.endswith(b"\n") and at + len(data) < size:
        more = handle.read(1 << 16)
        cut = more.find(b"\n")
        data += more if cut < 0 else more[: cut + 1]
    skip = data.find(b"\n") + 1 if begin else 0  # a line that began before the range is another range's
    return at + skip, data[skip:] if skip or not begin else b""


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def ranges(self) -> list[Bytes]:
        return [Bytes(f, at, min(at + self.range_bytes, size)) for f, size in data_files(self.path) for at in range(0, size, self.range_bytes)]


class RunReader(_Reader):
    """``(file, node, begin, end)``: the runs of lines of one node in each range."""

    def partitions(self) -> list[Bytes]:
        return self.ranges()

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.file) as handle:
            at, data = lines_from(handle, partition.begin, partition.end, handle.size())
        labels, begins, ends = [], [], []
        for line in data.splitlines(keepends=True):
            label = line.partition(b"\t")[0].strip(b" ")
            if at and line.strip() and not line.startswith(b"."):  # the first line of a file has the names of columns
                if not labels or labels[-1] != label:
                    labels.append(label)
                    begins.append(at)
                    ends.append(at)
                ends[-1] = at + len(line)
            at += len(line)
        columns = [pa.array([partition.file] * len(labels), pa.string()), pa.array([x.decode() for x in labels], pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["file", "node", "begin", "end"])


class BlockReader(_Reader):
    """``(node, site, p)`` of indexed blocks."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.index, self.states, self.nodes = options["index"], options.get("states", "nucl"), None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("node",):
                nodes = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.nodes = nodes if self.nodes is None else self.nodes & nodes
            else:
                yield f

    def partitions(self) -> list[Bytes]:
        fs, at = filesystem(self.index)
        index = pyarrow.parquet.read_table(at, filesystem=fs)
        if self.nodes is not None:
            rows = index.filter(pc.is_in(index.column("node"), pa.array(sorted(self.nodes), pa.string())))
            if missing := self.nodes - set(rows.column("node").to_pylist()):
                raise ValueError(f"the table has no block of node {min(missing)}")
            index = rows
        out: list[Bytes] = []
        for file, begin, end in sorted(zip(*(index.column(c).to_pylist() for c in ("file", "begin", "end")), strict=True)):
            last = out[-1] if out else None
            if last and (last.file, last.end) == (file, begin) and end - last.begin <= self.range_bytes:
                last.end = end
            else:
                out.append(Bytes(file, begin, end))
        return out or [Bytes("", 0, 0)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.file) as handle:
            data = handle.read_at(partition.end - partition.begin, partition.begin)
        if b"\n." in data or data.startswith(b"."):  # comments
            data = b"".join(line for line in data.splitlines(keepends=True) if not line.startswith(b"."))
        order, letters = FILE_ORDER[self.states], ALPHABETS[self.states]
        names = ["node", "site", "state", *order]
        kinds = {"node": pa.string(), "site": pa.int32(), "state": pa.string(), **dict.fromkeys(order, pa.float64())}
        rows = pyarrow.csv.read_csv(
            pa.py_buffer(data),
            read_options=pyarrow.csv.ReadOptions(column_names=names, use_threads=False),
            parse_options=pyarrow.csv.ParseOptions(delimiter="\t", quote_char=False),
            convert_options=pyarrow.csv.ConvertOptions(column_types={c: pa.string() for c in names}),
        )
        trimmed = {c: pc.utf8_trim(rows.column(c).combine_chunks(), " ").cast(kinds[c]) for c in names}
        values = np.stack([trimmed[c].to_numpy() for c in letters], axis=1)
        lists = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(letters), values.ravel())
        yield pa.RecordBatch.from_arrays([trimmed["node"], trimmed["site"], lists], ["node", "site", "p"])


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "twigmer_runs"

    def schema(self) -> str:
        return "file string, node string, begin long, end long"

    def reader(self, schema) -> DataSourceReader:
        return RunReader(self.options)


class BlockSource(DataSource):
    """Options: ``path``, ``index`` (see :func:`index_blocks`), ``states``, ``rangebytes``."""

    @classmethod
    def name(cls) -> str:
        return "twigmer_blocks"

    def schema(self) -> str:
        return "node string, site int, p array<double>"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def index_blocks(spark: SparkSession, path: str, index: str, range_bytes: int = RANGE_BYTES) -> None:
    """Write ``(node, file, begin, end)``, the last block of each node in the order of files and places, to ``index``.

    Ranges are scanned in parallel; a block that goes over from one range to the next is one. Comments (lines that begin
    with a dot) and blank lines belong to the block they stand in.
    """
    spark.dataSource.register(RunSource)
    runs = spark.read.format("twigmer_runs").option("path", path).option("rangebytes", range_bytes).load()
    order = Window.partitionBy("file").orderBy("begin")  # a row for each run of a node's lines
    fresh = F.coalesce(F.lag("node").over(order) != F.col("node"), F.lit(True))
    blocks = runs.withColumn("fresh", fresh.cast("int")).withColumn("block", F.sum("fresh").over(order))
    blocks = blocks.groupBy("file", "block", "node").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    last = blocks.groupBy("node").agg(F.max(F.struct("file", "begin", "end")).alias("last"))
    last.select("node", "last.*").write.mode("overwrite").parquet(index)


def read_blocks(spark: SparkSession, path: str, states: str = "nucl", index: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(node, site, logp)`` of a table; a filter on ``node`` by equality or a list reads these nodes' blocks only, and raises if one has none.

    Of several blocks of a node the last counts. ``index`` is written first where it isn't given. The driver plans
    from it: one row a node.
    """
    if index is None:
        index = new_path(spark)
        index_blocks(spark, path, index, range_bytes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
    reader = spark.read.format("twigmer_blocks").option("path", path).option("index", index).option("states", states).option("rangebytes", range_bytes)
    return reader.load().select("node", "site", F.transform("p", log_probability).alias("logp"))
