"""Queries that run the given tables through streams; the SQL says what the batches together must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import refs, times
from tidemark.operators import ledger
from tidemark.plans.adapters import DAY, HOUR, OBS_SQL, observations
from tidemark.plans.queries import BATCH_SQL, QUERIES, query
from tidemark.sources import schemas, shared
from tidemark.streaming import ledger_sink, observed, replay, sealing

LATEST = 12  # hours after which a row counts as late
FACTS_SQL = f"""WITH {OBS_SQL}, w AS (SELECT *, sum((outcome = 'ok')::INTEGER) OVER v AS oks FROM obs WINDOW v AS (PARTITION BY repo, ref ORDER BY us, event_id)),
sn AS (SELECT *, (sum(CASE WHEN outcome = 'ok' OR (outcome = 'not_modified' AND oks > 0) THEN 1 ELSE 0 END) OVER (PARTITION BY repo, ref ORDER BY us, event_id))::BIGINT AS n FROM w),
rx AS (SELECT *, k % 7 <> 0 AS resolved FROM obs WHERE outcome = 'ok'),
rc AS (SELECT *, CASE WHEN lag(resolved) OVER w = resolved AND lag(commit_no) OVER w = commit_no THEN 0 ELSE 1 END AS ch FROM rx WINDOW w AS (PARTITION BY repo, ref ORDER BY us, event_id)),
ri AS (SELECT *, sum(ch) OVER (PARTITION BY repo, ref ORDER BY us, event_id) AS island FROM rc),
rr AS (SELECT repo, ref, island, any_value(resolved) AS resolved, any_value(commit_no) AS commit_no, min(us) AS first_us, count(*) AS n FROM ri GROUP BY 1, 2, 3),
rl AS (SELECT *, lag(resolved) OVER w AS pr, lag(commit_no) OVER w AS pc, lag(first_us) OVER w AS first_seen, lag(n) OVER w AS held FROM rr WINDOW w AS (PARTITION BY repo, ref ORDER BY island)),
{BATCH_SQL.split("WITH", 1)[1].replace(OBS_SQL + ",", "", 1).strip()}
SELECT 'seen' AS kind, repo, event_id, ref, us, NULL AS target, n, oks::BIGINT AS ok_only, NULL AS since, NULL AS members FROM sn
UNION ALL SELECT 'release', repo, NULL, ref, first_us, commit_no, held, NULL, first_seen, NULL FROM rl WHERE resolved AND NOT pr AND pc = commit_no
UNION ALL SELECT 'batch', repo, event_id, ref, us, commit_no, len(members), NULL, batch_start, array_to_string(members, ',') FROM bt"""


@query(FACTS_SQL)
def q49_observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of bindings, releases of held facts and batches from a stream with state, ten days a trigger, out of order within hours."""
    o = observations(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    last = o.agg(F.max("us").alias("us")).select((F.col("us") + 2 * DAY).alias("us"))
    arrival = F.floor((F.col("us") + F.col("event_id") % 7 * HOUR) / (10 * DAY))
    rows = o.select(F.col("repo").cast("long").alias("repo"), "event_id", "ref", "us", "outcome", F.col("commit_no").alias("target"), (F.col("k") % 7 != 0).alias("resolved"), (refs.ref_form(F.col("ref")) == "exact").alias("exact"), "ts", arrival.alias("batch"))
    # a row two days after all others, which waits for good, moves the watermark past them
    end = last.where("us is not null").select(*[F.lit(-1).cast("long").alias(c) if c in ("repo", "event_id", "target") else F.lit("").alias(c) if c in ("ref", "outcome") else F.lit(False).alias(c) if c in ("resolved", "exact") else F.col("us") if c == "us" else F.timestamp_micros("us").alias(c) if c == "ts" else F.lit(1 << 40).alias(c) for c in rows.columns])
    folder = shared.folder(spark, "facts")
    found = replay.finish(observed.facts(replay.arrive(rows.unionByName(end), "batch", folder), DAY, f"{LATEST} hours"), folder)
    return found.withColumn("members", F.array_join("members", ","))


ARRIVED_SQL = f"""WITH {OBS_SQL}, r AS (SELECT *, (us + event_id % 7 * {HOUR}) // {10 * DAY} AS batch, make_timestamp(us)::DATE AS day, epoch_us(make_timestamp(us)::DATE::TIMESTAMP) AS begins FROM obs WHERE day(make_timestamp(us)) % 5 <> 0),
b AS (SELECT batch, max(us) // 1000 AS top FROM r GROUP BY batch),
w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATEST * 3_600_000} AS wm FROM b),
f AS (SELECT max(top) - {LATEST * 3_600_000} AS wm FROM b)"""
SEALED_SQL = ARRIVED_SQL + """, d AS (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT make_timestamp(max(wm) * 1000)::DATE - 1 FROM f), INTERVAL 1 DAY))::DATE AS day),
sd AS (SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT repo) AS repos_polled, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'not_modified') AS not_modified, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped
  FROM d LEFT JOIN r ON r.day = d.day GROUP BY d.day)"""


def arriving(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream of observations without each fifth day of a month, ten days a trigger, out of order by up to six hours."""
    o = observations(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")).where(F.dayofmonth("ts") % 5 != 0)
    return replay.arrive(o.select("event_id", F.col("repo").cast("long").alias("repo"), "outcome", "us", "ts", F.floor((F.col("us") + F.col("event_id") % 7 * HOUR) / (10 * DAY)).alias("batch")), "batch", folder)


@query(ARRIVED_SQL + " SELECT event_id, strftime(day, '%Y-%m-%d') AS day, coalesce(w.wm * 1000 < begins, true) AS buffered FROM r JOIN w ON w.batch = r.batch, f WHERE begins <= f.wm * 1000")
def q50_day_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be written, as all days before theirs are sealed, and whether they had to wait for it."""
    folder = shared.folder(spark, "barrier")
    return replay.finish(sealing.held(arriving(spark, sf_dir, folder), "ts", f"{LATEST} hours", "event_id"), folder).select("event_id", "day", "buffered")


@query(SEALED_SQL + " SELECT * FROM sd")
def q51_sealed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of sealed days from a stream, days without rows included."""
    folder = shared.folder(spark, "sealed")
    return replay.finish(sealing.digests(arriving(spark, sf_dir, folder), "ts", f"{LATEST} hours"), folder)


@query(SEALED_SQL + """, e AS (SELECT strftime(day, '%Y-%m-%d') AS day, us, 0 AS digest FROM r, f WHERE us < f.wm * 1000
  UNION ALL SELECT strftime(day::DATE + 1, '%Y-%m-%d'), epoch_us((day::DATE + 1)::TIMESTAMP), 1 FROM sd),
q AS (SELECT *, row_number() OVER (ORDER BY us // 1000, digest DESC) - 1 AS seq FROM e)
SELECT day, count(*) AS n, sum(digest)::BIGINT AS digests, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(digest, seq) = 1 AS begins_with_digest, 0::BIGINT AS violations FROM q GROUP BY day""")
def q52_ledger_of_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that a stream appends to, rows in order and each day after the digest of the one before, by day."""
    c = F.col
    folder, path = shared.folder(spark, "commits"), shared.folder(spark, "stream-ledger")
    rows = sealing.held(arriving(spark, sf_dir, folder), "ts", f"{LATEST} hours", "event_id", ordered=True)
    rows = rows.select(F.lit("correction").alias("event"), times.wire(F.timestamp_micros("us")).alias("recorded_at"), c("event_id").cast("string").alias("reason"), F.lit(0).cast("long").alias("corrects_seq"), *[F.lit(None).cast("long").alias(x) for x in sealing.COUNTS], F.lit(None).cast("string").alias("date"))
    days = sealing.digests(arriving(spark, sf_dir, f"{folder}/days"), "ts", f"{LATEST} hours")
    sealed_at = F.concat(F.date_format(F.date_add(F.to_date("day"), 1), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    days = days.select(F.lit("observation_digest").alias("event"), sealed_at.alias("recorded_at"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("corrects_seq"), *sealing.COUNTS, c("day").alias("date"))
    kinds = spark.createDataFrame([], schemas.ENTRY).schema

    def entries(batch: DataFrame, number: int) -> None:
        payload = F.struct(*[(F.array() if f.name == "files" else c(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds["observation_digest"].dataType])
        own = {"event": c("event"), "recorded_at": c("recorded_at"), "reason": c("reason"), "corrects_seq": c("corrects_seq"), "format_version": F.lit(1), "observation_digest": F.when(c("event") == "observation_digest", payload)}
        whole = batch.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds if f.name not in ("seq", "prev_hash", "entry_hash")])
        ledger_sink.append(whole.withColumn("_late", (c("event") != "observation_digest").cast("int")), number, path, ["recorded_at", "_late", "reason"], drop=["_late"])

    replay.finish(rows.unionByName(days), folder, entries)
    written = ledger_sink.committed(spark, path, kinds)
    bad = ledger.violations(written).groupBy("seq").agg(F.count("*").alias("bad"))
    digest = (c("event") == "observation_digest").cast("long")
    by_day = written.join(bad, "seq", "left").withColumn("digest", digest).groupBy(F.substring("recorded_at", 1, 10).alias("day"))
    return by_day.agg(F.count("*").alias("n"), F.sum("digest").alias("digests"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), (F.min_by("digest", "seq") == 1).alias("begins_with_digest"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"))


__all__ = ["QUERIES"]
