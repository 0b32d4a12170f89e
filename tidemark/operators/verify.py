"""One verdict on a ledger: rows, heads, files, then the strict checks; the first stage that fails decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import heads as head_rules
from tidemark.operators import ledger as ledger_rules
from tidemark.sources import files as file_rules

STAGES = ("rows", "heads", "files", "strict")
BACKLOG = "witness backlog"


def head_failures(heads: DataFrame, ledger: DataFrame) -> DataFrame:
    """seq and what of head lines that name no row or another hash than the row's, and of numbers with two heads."""
    named = heads.select(F.col("head.seq").alias("seq"), F.col("head.entry_hash").alias("_hash")).distinct()
    rows = named.join(ledger.select("seq", F.col("entry_hash").alias("_own")), "seq", "left")
    what = F.when(F.col("_own").isNull(), "head of no row").when(F.col("_own") != F.col("_hash"), "head of another hash")
    single = rows.select("seq", what.alias("what")).where("what is not null")
    return single.unionByName(head_rules.two_faced(heads).select("seq", F.lit("two heads of one row").alias("what")))


def strict_failures(ledger: DataFrame, heads: DataFrame, hours: int = 48) -> DataFrame:
    """Rows that no head covers though they are that much older than the ledger's last, and digests whose note tells of a backlog."""
    covered = heads.agg(F.coalesce(F.max("head.seq"), F.lit(-1)).alias("_covered"))  # one row
    rows = ledger.select("seq", F.unix_micros(times.strict(F.col("recorded_at"))).alias("_us"), F.lit(True).alias("_open"))
    late = ledger_rules.backlog(rows, "_us", hours, F.col("_open")).join(F.broadcast(covered)).where("seq > _covered")
    noted = ledger.where(F.contains("observation_digest.note", F.lit(BACKLOG)))
    return late.select("seq", F.lit("no head for too long").alias("what")).unionByName(noted.select("seq", F.lit("note of a backlog").alias("what")))


def verdict(ledger: DataFrame, heads: DataFrame, files: DataFrame, strict: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row: entries, first_seq, last_seq, skipped, failed, stage, bad_seq, failure; stage is null if nothing is wrong.

    files: path and sha256 (sha256:...) of what is on disk; files that aren't there are no failure. With first
    and last only rows of that range count for the verdict, though all are read to check their links.
    An empty ledger is valid.
    """
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("seq") >= first)
    if last is not None:
        inside = inside & (F.col("seq") <= last)
    named = ledger.where("event = 'observation_digest'").select("seq", F.col("observation_digest.files").alias("files"))
    found = [
        ledger_rules.violations(ledger).select(F.lit(0).alias("_stage"), "seq", "rank", "what"),
        head_failures(heads, ledger).select(F.lit(1).alias("_stage"), "seq", F.lit(0).alias("rank"), "what"),
        file_rules.files_of_other_bytes(named, files).select(F.lit(2).alias("_stage"), "seq", F.lit(0).alias("rank"), F.concat(F.lit("changed file "), F.col("path")).alias("what")),
    ]
    if strict:
        found.append(strict_failures(ledger, heads).select(F.lit(3).alias("_stage"), "seq", F.lit(0).alias("rank"), "what"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    worst = every.where(inside).agg(F.min(F.struct("_stage", "seq", "rank", "what")).alias("_w"))
    digest = F.col("observation_digest")
    span = ledger.where(inside).agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.coalesce(F.sum(digest["skipped"]), F.lit(0)).alias("skipped"), F.coalesce(F.sum(digest["failed"]), F.lit(0)).alias("failed"))
    stage = F.coalesce(*[F.when(F.col("_w._stage") == k, F.lit(s)) for k, s in enumerate(STAGES)])
    return span.join(F.broadcast(worst)).select(*span.columns, F.when(F.col("_w").isNotNull(), stage).alias("stage"), F.col("_w.seq").alias("bad_seq"), F.col("_w.what").alias("failure"))  # one row each
