"""The engine's inputs, taken from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import micros

REFS = ("v1", "v1.2", "v1.2.3", "v1.2.4", "v2.0.0-rc.1", "v3.0.0", "latest", "2024.01.15")
HOUR, DAY = 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of ten repositories, from the event stream; us is the instant in microseconds."""
    return as_observations(table(spark, sf_dir, "events"))


def as_observations(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "view", "not_modified").otherwise("ok")
    refs = F.array(*[F.lit(r) for r in REFS])
    commit = F.floor(F.col("k") / 8) % 4
    return events.select("event_id", "user_id", (F.col("user_id") % 10).alias("repo"), micros(F.col("ts")).alias("us"), k.alias("k"), outcome.alias("outcome")).select(
        "*", F.element_at(refs, F.col("k") % 8 + 1).alias("ref"), commit.alias("commit_no"), F.floor(commit / 2).alias("tree_no")
    )


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


OBS_SQL = """
obs AS (
  SELECT event_id, user_id, user_id % 10 AS repo, epoch_us(ts) AS us, k,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'not_modified' ELSE 'ok' END AS outcome,
         ['v1', 'v1.2', 'v1.2.3', 'v1.2.4', 'v2.0.0-rc.1', 'v3.0.0', 'latest', '2024.01.15'][k % 8 + 1] AS ref,
         ((k // 8) % 4)::BIGINT AS commit_no, (((k // 8) % 4) // 2)::BIGINT AS tree_no
  FROM (SELECT *, (props::JSON->>'$.k')::INTEGER AS k FROM events))
"""


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return str(x)
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + x.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
