"""The ledger as a stream's sink: each batch is appended once, linked to what is there.

``rows/batch=N`` has a batch's linked rows and ``commits/batch=N`` one row of the tip after it, which is written
last: a batch that stopped between the two is written again over what it left, and one whose commit is there
is skipped, so a stream may repeat its last batch at any time. Rows without a commit are not read.

A batch is refused, and nothing of it written, if its time goes behind the tip's, or if a day that follows others
doesn't begin with an observation_digest.

Defined cases: an empty batch is committed with the tip unchanged; a null recorded_at is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.sources.shared import stage

COMMIT = "batch long, seq long, entry_hash string, recorded_at string, n long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row a committed batch: the tip after it and how many rows it appended."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The ledger's rows, of committed batches only."""
    done = commits(spark, path).where("n > 0").select("batch")
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")  # one row a batch


def refusals(rows: DataFrame, order: list[str], tip_at: str | None) -> DataFrame:
    """recorded_at and why of rows that may not follow the tip."""
    late = rows.where(F.col("recorded_at").isNull() | (F.col("recorded_at") < F.lit(tip_at or ""))).select("recorded_at", F.lit("time goes backwards").alias("why"))
    day = F.substring("recorded_at", 1, 10)
    first = rows.groupBy(day.alias("_day")).agg(F.min(F.struct(*order, "event")).alias("_f"), F.min("recorded_at").alias("recorded_at"))
    before = F.lag("_day").over(Window.orderBy("_day"))  # one row a day
    opened = F.coalesce(before, F.lit(tip_at[:10] if tip_at else None))
    bare = first.withColumn("_before", opened).where("_before < _day and _f.event <> 'observation_digest'")
    return late.unionByName(bare.select("recorded_at", F.lit("day without a digest at its beginning").alias("why")))


def append(batch: DataFrame, number: int, path: str, order: list[str], drop: list[str] | None = None) -> str:
    """Append a batch in an order (whose columns to drop aren't written); ``committed``, or ``skipped`` if it is there already."""
    spark = batch.sparkSession
    done = commits(spark, path)
    if not done.where(F.col("batch") >= number).isEmpty():
        return "skipped"
    tip = done.orderBy(F.col("batch").desc()).first()
    rows = stage(batch, "ledger-batch")
    if (bad := refusals(rows, order, tip and tip.recorded_at).first()) is not None:
        raise ValueError(f"{bad.why} at {bad.recorded_at}, batch {number}")
    linked = ledger.link(rows, order, (tip.seq, tip.entry_hash) if tip else (-1, ledger.GENESIS), drop or [])
    linked.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    written = spark.read.schema(linked.schema).parquet(f"{path}/rows/batch={number}")
    last = written.agg(F.max_by(F.struct("seq", "entry_hash", "recorded_at"), "seq").alias("t"), F.count("*").alias("n")).first()
    at = last.t or tip
    row = (number, at.seq if at else -1, at.entry_hash if at else ledger.GENESIS, at.recorded_at if at else None, last.n)
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return "committed"


def sink(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""
    return lambda batch, number: None if append(batch, number, path, order) else None
