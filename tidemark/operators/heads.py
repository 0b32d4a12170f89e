"""Signed heads of the ledger: checks against its rows, identity, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.canonical import canonical_json, key_id
from tidemark.functions.ed25519 import verified


def failures(heads: DataFrame, ledger: DataFrame) -> DataFrame:
    """seq and what of every head line that isn't right: no such row, another hash, key or signature."""
    h = heads.select("head.*", F.col("key_id").alias("_key_id"), "public_key", "signature")
    message = canonical_json(heads.select("head.*"), heads.select("head.*").columns)
    h = h.withColumn("_message", message).join(ledger.select("seq", F.col("entry_hash").alias("_row_hash")), "seq", "left")
    what = (
        F.when(F.col("_row_hash").isNull(), "no such row")
        .when(F.col("_row_hash") != F.col("entry_hash"), "another hash")
        .when(F.coalesce(key_id(F.col("public_key")) != F.col("_key_id"), F.lit(True)), "another key")
        .when(~verified("public_key", "_message", "signature"), "bad signature")
    )
    return h.withColumn("what", what).where("what is not null").select("seq", "what")


def two_faced(heads: DataFrame) -> DataFrame:
    """Numbers whose head lines don't all have the same head and signature."""
    return heads.groupBy(F.col("head.seq").alias("seq")).agg(F.count_distinct(F.struct("head", "signature")).alias("different")).where("different > 1")


def stale(ledger: DataFrame, heads: DataFrame, hours: int = 48) -> DataFrame:
    """Rows that the latest head does not cover though they are that much older than it."""
    last = heads.agg(F.max(times.strict(F.col("head.recorded_at"))).alias("_last"), F.max("head.seq").alias("_seq"))
    rows = ledger.select("seq", times.strict(F.col("recorded_at")).alias("_at")).join(F.broadcast(last))
    return rows.where((F.col("seq") > F.col("_seq")) & (F.col("_at") <= F.col("_last") - F.expr(f"interval {hours} hours"))).select("seq")
