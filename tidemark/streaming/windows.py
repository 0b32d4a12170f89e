"""Event-time rollups of the observation stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ("repos_polled", "ok", "not_modified", "failed", "skipped")


def counts(observations: DataFrame, at: str = "ts", late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Counts by outcome of each closed window; rows later than the watermark are left out.

    The state of a window holds the set of its repositories, which are as many as are watched.
    """
    return (
        observations.withWatermark(at, late)
        .groupBy(F.window(at, length))
        .agg(F.size(F.collect_set("repo")).cast("long").alias("repos_polled"), *[F.count_if(F.col("outcome") == x).alias(x) for x in COUNTS[1:]])
    )


def digest(observations: DataFrame, at: str = "ts", late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """The counts by the window's beginning."""
    return counts(observations, at, late, length).select(F.col("window.start").alias("start"), *COUNTS)
