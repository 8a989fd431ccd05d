"""Single files on whatever file system a path names, by Hadoop's interface: what formats of one file and outside tools need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_file(rows: DataFrame, path: str) -> None:
    """Write the lines ``rows(value)``, of one partition, as one text file; one that is there is replaced."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").text(f"{path}.parts")
    fs, parts = _at(spark, f"{path}.parts")
    found = [f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")]
    if len(found) != 1:
        raise ValueError(f"{len(found)} parts of {path}; the lines have to be one partition")
    _, target = _at(spark, path)
    fs.delete(target, False)
    if not fs.rename(found[0], target):
        raise OSError(f"{path} can't be written")
    fs.delete(parts, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a short text as a file."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def list_files(spark: SparkSession, folder: str) -> dict[str, int]:
    """The paths of a folder's files, in order, with their sizes."""
    fs, at = _at(spark, folder)
    return {f.getPath().toString(): f.getLen() for f in sorted(fs.listStatus(at), key=lambda f: f.getPath().toString()) if f.isFile()}


def to_driver(spark: SparkSession, path: str, local: str) -> str:
    """Copy a file to the driver's disk, for a tool that runs there."""
    fs, at = _at(spark, path)
    fs.copyToLocalFile(False, at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
    return local


def from_driver(spark: SparkSession, local: str, path: str) -> str:
    """Copy a file of the driver's disk to where all can read it."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), at)
    return path
