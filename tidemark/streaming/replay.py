"""Run a table through a stream, batch after batch, and read what the stream wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def arrive(rows: DataFrame, batch: str, folder: str) -> DataFrame:
    """A stream of the rows without their batch number, one file a trigger, in the order of the numbers.

    The numbers stand for arrival and should be few: each costs one write and one trigger.
    """
    spark = rows.sparkSession
    rows.repartition(batch).write.partitionBy(batch).parquet(f"{folder}/all")
    numbers = spark.read.parquet(f"{folder}/all").select(F.col(batch).cast("long")).distinct().collect()
    for (k,) in sorted(numbers):
        spark.read.parquet(f"{folder}/all/{batch}={k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows.drop(batch).limit(0).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream to the end of what is there; the rows it wrote. With a sink, that gets the batches and the result is empty."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        q = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(f"{folder}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return spark.createDataFrame([], stream.schema) if sink else spark.read.schema(stream.schema).parquet(f"{folder}/out")
