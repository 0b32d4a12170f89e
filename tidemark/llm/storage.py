"""Tables written between jobs, in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import folder, stage

__all__ = ["folder", "likely_in", "stage", "table", "with_likely", "with_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILTER_BITS = 1 << 24
_BUCKET = 1 << 15


def with_likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows with _likely: true where their key is in ``keys``, and for a few others by chance.

    A bitmap of FILTER_BITS bits marks the hashes of the keys; it has 2 MB whatever the size of the
    tables, so it is broadcast. It spares joins the shuffle of most rows that match nothing (fewer, the
    more keys there are: it fills up with some tens of millions); those
    joins decide.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    marks = keys.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = df.withColumn("_p", place).withColumns({"_bucket": F.bitmap_bucket_number("_p"), "_bit": F.bitmap_bit_position("_p")})
    marked = rows.join(F.broadcast(marks), "_bucket", "left")
    set_ = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)), F.lit(2)) == 1
    return marked.withColumn("_likely", F.coalesce(set_, F.lit(False))).select(*df.columns, "_likely")


def with_row(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as the one struct ``row`` beside the columns of ``more``, which so clash with none of its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def likely_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys``, and a few others by chance."""
    return with_likely(df, key, keys).where("_likely").drop("_likely")
