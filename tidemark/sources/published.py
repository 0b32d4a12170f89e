"""Published files compared and hashed line by line, so that no file is ever one value.

A line is what ends in a line feed; a file's last line may lack it. What is compared moves as a line's
place in its file and digest, a few dozen bytes. Spark's readers pass over files of
no bytes: these are the beginning of anything, and count as absent here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stage


Name = Callable[[Column], Column]


def relative(file: Column, folder: str, name: Name | None = None) -> Column:
    """A file's path below a folder, or the name that is made of its whole path."""
    if name:
        return name(file)
    base = folder.split("://")[-1].rstrip("/").replace("file:", "")
    return F.substring(file, F.instr(file, base) + len(base) + 1, F.length(file))


def sizes(spark: SparkSession, folder: str, name: Name | None = None) -> DataFrame:
    """path and bytes of every file below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(relative(F.col("path"), folder, name).alias("path"), F.col("length").alias("bytes"))


def lines(spark: SparkSession, folder: str, name: Name | None = None) -> DataFrame:
    """path, start, n and the raw value of every line, with its file's size; start and n give the order.

    A split is read by one task from its first line to its last, so lines of one split are in the order of n.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(folder)
    return raw.select(
        relative(F.col("_metadata.file_path"), folder, name).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_size").alias("size"),
    )


def places(spark: SparkSession, folder: str, name: Name | None = None) -> DataFrame:
    """path, at (the byte where it begins) and digest of every line.

    Places are sums within splits and then over a file's splits, so that no task holds a whole file.
    """
    rows = lines(spark, folder, name).select("path", "start", "n", (F.octet_length("value") + 1).cast("long").alias("bytes"), F.sha2("value", 256).alias("digest"))
    rows = stage(rows, "lines")
    split = rows.groupBy("path", "start").agg(F.sum("bytes").alias("_b"))
    split = split.select("path", "start", (F.sum("_b").over(Window.partitionBy("path").orderBy("start")) - F.col("_b")).alias("_before"))
    within = F.sum("bytes").over(Window.partitionBy("path", "start").orderBy("n")) - F.col("bytes")
    return rows.withColumn("_within", within).join(split, ["path", "start"]).select("path", (F.col("_before") + F.col("_within")).alias("at"), "digest")


def not_appended(spark: SparkSession, old: str, new: str, name: Name | None = None) -> DataFrame:
    """Files of a folder that aren't the beginning of their namesakes in the new one: gone, shorter or changed.

    A last line without its end must be a whole line of the new file too: one that was written on counts as changed.
    """
    then, now = sizes(spark, old, name), sizes(spark, new, name).select("path", F.col("bytes").alias("_now"))
    cut = then.join(now, "path", "left").where("_now is null or _now < bytes").select("path")
    other = places(spark, old, name).join(places(spark, new, name).withColumnRenamed("digest", "_now"), ["path", "at"], "left").where("not digest <=> _now").select("path")
    return cut.unionByName(other).distinct()


def digests(spark: SparkSession, folder: str, name: Name | None = None) -> DataFrame:
    """path, bytes and sha256 (with its prefix) of every file below a folder.

    A hash goes over a file's bytes in order, so a file is one task's work; the task holds a batch of lines.
    """
    ordered = lines(spark, folder, name).repartition("path").sortWithinPartitions("path", "start", "n").select("path", "value", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, read, sha = None, 0, 0, hashlib.sha256()

        def row() -> pa.RecordBatch:
            if read != size:
                raise ValueError(f"{read} bytes read of {size} in {path}")
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array(["sha256:" + sha.hexdigest()])], ["path", "bytes", "sha256"])

        for batch in batches:
            for p, value, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path:
                    if path is not None:
                        yield row()
                    path, size, read, sha = p, n, 0, hashlib.sha256()
                sha.update(value)
                read += len(value)
                if read < size:
                    sha.update(b"\n")
                    read += 1
        if path is not None:
            yield row()

    return ordered.mapInArrow(run, "path string, bytes long, sha256 string")
