"""JSON lines in day files, journals of which the last record counts, and other plain files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical, refs
from tidemark.sources import schemas

DAY_FILE = r"/(\d{4}/\d{2}/\d{2}\.jsonl|day=\d{4}-\d{2}-\d{2}/part-[^/]+)$"
DAY_AND_REPO = r"/(?:obs_date=)?(\d{4})[/-](\d{2})[/-](\d{2})/(?:slug=)?([^/]+?)(?:\.jsonl|/part-[^/]+)$"


def lines(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Every line below a folder that isn't blank, with its file; only files that match a pattern."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.jsonl,part-*}").text(path)
    raw = raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim("line") != "")
    return raw.where(F.col("file").rlike(only)) if only else raw


def parsed(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of lines that parse, with file and line, and the others for quarantine (torn or corrupt)."""
    rows = raw.withColumn("_row", F.from_json("line", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    return rows.where(~bad).select("_row.*", "file", "line").drop("_corrupt"), rows.where(bad).select("file", "line")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ledger's day files, in any order; use ignored() for what else is there.

    A line that doesn't parse ends the query with its file's name: a ledger with a torn or corrupt line
    is read with parsed(), which sets such lines aside.
    """
    return whole(lines(spark, path, DAY_FILE), schemas.ENTRY).drop("file", "line")


def whole(raw: DataFrame, schema: str) -> DataFrame:
    """Rows of lines with file and line; an error if one doesn't parse."""
    rows = raw.withColumn("_row", F.from_json("line", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    refused = F.raise_error(F.concat(F.lit("corrupt line in "), F.col("file"))).cast("boolean")
    return rows.where(F.when(bad, refused).otherwise(F.lit(True))).select("_row.*", "file", "line").drop("_corrupt")


def ignored(spark: SparkSession, path: str) -> DataFrame:
    """Files below a ledger's folder that aren't day files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.where(~F.col("path").rlike(DAY_FILE))


def closed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of parsed() whose line has keys that the schema doesn't know, with these keys."""
    known = rows.sparkSession.createDataFrame([], schema).columns
    return rows.withColumn("unknown", canonical.unknown_keys(F.col("line"), known)).where(F.size("unknown") > 0)


def observations(spark: SparkSession, path: str, repo: str | None = None, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
    """Observations of day and repository files, with obs_date; other files aren't read where asked for some."""
    raw = lines(spark, path, DAY_AND_REPO)
    day = F.concat_ws("-", *[F.regexp_extract("file", DAY_AND_REPO, k) for k in (1, 2, 3)])
    raw = raw.withColumn("obs_date", F.to_date(day))
    if repo:
        raw = raw.where(F.regexp_extract("file", DAY_AND_REPO, 4) == repo.replace("/", "--"))
    if day_from:
        raw = raw.where(F.col("obs_date") >= day_from)
    if day_to:
        raw = raw.where(F.col("obs_date") <= day_to)
    return whole(raw.select("line", "file", "obs_date"), schemas.OBSERVATION).withColumn("obs_date", F.to_date(F.concat_ws("-", *[F.regexp_extract("file", DAY_AND_REPO, k) for k in (1, 2, 3)]))).drop("file", "line")


def ok_observations(rows: DataFrame, repo: str) -> DataFrame:
    """The ok observations of one repository, oldest first."""
    return rows.where((F.col("repo") == repo) & (F.col("outcome.type") == "ok")).orderBy("observed_at", "observation_id")


def journal(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last record of each key of a journal file, by its place in it.

    Files are read in splits. A split is read by one task from its first line to its last, so a line's
    place is the split's start and, within it, the number that rows of a task get in order.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    raw = spark.read.text(path).select(F.col("value").alias("line"), place.alias("place"), F.col("_metadata.file_path").alias("file"))
    rows = raw.where(F.trim("line") != "").withColumn("_row", F.from_json("line", schema, {"mode": "FAILFAST"})).select("file", "place", "_row.*")
    rest = [c for c in rows.columns if c not in (*keys, "file", "place")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("file", "place")).alias("_r"))
    return best.select(*keys, "_r.*")


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of an immutable table that were given different values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def watched(spark: SparkSession, path: str) -> DataFrame:
    """The watched population; an error if a repository isn't owner/name."""
    rows = spark.read.schema(schemas.WATCHED).json(path)
    bad = ~F.coalesce(refs.is_slug(F.col("repo")), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("not owner/name: "), F.coalesce("repo", F.lit("null")))).cast("boolean")
    return rows.where(F.when(bad, refused).otherwise(F.lit(True)))


def actions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ground-truth actions and their corrections, from one file."""
    rows = spark.read.schema(schemas.ACTION).json(path)
    return rows.where("kind <> 'correction' or kind is null"), rows.where("kind = 'correction'")


def skip_reason(reason) -> dict:
    """Kind and range of a skip's reason, which is a bare string or an object of one key."""
    text = F.coalesce(reason, F.lit(""))
    has = lambda k: F.get_json_object(text, f"$.{k}").isNotNull() | (F.trim(F.regexp_replace(text, '"', "")) == k)
    down = F.get_json_object(text, "$.poller_down.from").isNotNull() & F.get_json_object(text, "$.poller_down.to").isNotNull()
    kind = F.when(down, "poller_down").when(has("secondary_limit_backoff"), "secondary_limit_backoff").when(has("scheduler_lag"), "scheduler_lag")
    return {"kind": kind, "down_from": F.get_json_object(text, "$.poller_down.from"), "down_to": F.get_json_object(text, "$.poller_down.to")}


def slugs(spark: SparkSession, path: str) -> DataFrame:
    """Repository names of a list file, without comments."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("repo"))
    return rows.where("repo <> ''")


# sinks


def write_ledger(rows: DataFrame, path: str) -> None:
    """Append ledger rows as canonical JSON lines, in folders by the day of recorded_at."""
    text = canonical.canonical_json(rows, rows.columns)
    day = F.substring("recorded_at", 1, 10)
    out = rows.select(day.alias("day"), "seq", text.alias("value")).repartition("day").sortWithinPartitions("day", "seq")
    out.select("day", "value").write.mode("append").partitionBy("day").text(path)


def write_observations(rows: DataFrame, path: str) -> None:
    """Append observations by the day on which they were completed, and repository."""
    keyed = rows.withColumns({"obs_date": F.substring("observed_at", 1, 10), "slug": F.replace("repo", F.lit("/"), F.lit("--"))})
    keyed.repartition("obs_date", "slug").write.mode("append").partitionBy("obs_date", "slug").json(path)


def files_of_other_bytes(digests: DataFrame, files: DataFrame) -> DataFrame:
    """Files named by digests (seq, files of path and sha256) that have another sha256 among files (path, sha256)."""
    named = digests.select("seq", F.explode("files").alias("f")).select("seq", "f.path", "f.sha256")
    return named.join(files.select("path", F.col("sha256").alias("_own")), "path").where("sha256 <> _own").select("seq", "path")
