"""Which target a reference was bound to, when: moves, runs, deletions, recreations, unresolved facts.

All windows are partitioned by reference, so tasks share nothing and any number of references scales
out; every order ends in the unique observation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_reference(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def with_previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the reference's row before, as prev_<column>."""
    w = by_reference(keys, order)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def moves(rows: DataFrame, keys: list[str], order: list[str], target: str, columns: list[str]) -> DataFrame:
    """Rows whose target differs from that of the reference's row before."""
    return with_previous(rows, keys, order, [target, *[c for c in columns if c != target]]).where(F.col(f"prev_{target}").isNotNull() & (F.col(f"prev_{target}") != F.col(target)))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows with island, the number of the run of equal values that they are in."""
    w = by_reference(keys, order)
    changed = F.coalesce((F.lag(value).over(w) != value).cast("int"), F.lit(1))
    return rows.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """One row per run of a value: first and last instant, and how many rows it has."""
    return islands(rows, keys, order, F.col(value)).groupBy(*keys, "island").agg(F.first(value).alias(value), F.min(at).alias("first_observed"), F.max(at).alias("last_observed"), F.count("*").alias("observation_count"))


def absent(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """References of one full listing that the next one lacks."""
    return previous.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti")


def recreations(presence: DataFrame, keys: list[str], day: str) -> DataFrame:
    """References that are listed again after a gap: the day, the day last seen, and days in between."""
    seen = presence.select(*keys, day).distinct()
    before = with_previous(seen, keys, [day], [day])
    gap = F.datediff(F.col(day), F.col(f"prev_{day}"))
    return before.withColumn("gap_days", gap).where("gap_days > 1")


def movement_count(previous: DataFrame, current: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Changed targets, deletions and creations between two listings; creations don't count as movement."""
    a = previous.select(*keys, F.col(target).alias("_a"), F.lit(True).alias("_in_a"))
    b = current.select(*keys, F.col(target).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full_outer")
    changed, gone, made = F.col("_a") != F.col("_b"), F.col("_in_b").isNull(), F.col("_in_a").isNull()
    return both.agg(F.count_if(changed).alias("changed"), F.count_if(gone).alias("deleted"), F.count_if(made).alias("created"), F.count_if(changed | gone).alias("movement"))


def live_counts(rows: DataFrame, keys: list[str], order: list[str], outcome: Column, count_not_modified: bool) -> DataFrame:
    """Observations of the current run of ok rows so far; unchanged polls extend it if they count."""
    w = by_reference(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    counts = (outcome == "ok") | ((outcome == "not_modified") & F.lit(count_not_modified) & (F.sum(F.when(outcome == "ok", 1).otherwise(0)).over(w) > 0))
    return rows.withColumn("observation_count", F.sum(counts.cast("long")).over(w))


def deferred(rows: DataFrame, keys: list[str], order: list[str], resolved: Column, target: str, at: str) -> DataFrame:
    """Facts that couldn't be resolved when first seen, at the row that resolves them.

    A run of unresolved rows of one target starts the clock at its first row; a second target starts
    it anew. The row after the run releases the fact with the run's first instant if it resolves the
    same target.
    """
    flagged = islands(rows.withColumn("_ok", resolved), keys, order, F.struct("_ok", target))
    run = flagged.groupBy(*keys, "island").agg(F.first("_ok").alias("_ok"), F.first(target).alias(target), F.min(at).alias("first_observed"), F.count("*").alias("n"))
    v = Window.partitionBy(*keys).orderBy("island")
    run = run.withColumns({"_ok_before": F.lag("_ok").over(v), "_target_before": F.lag(target).over(v), "first_seen": F.lag("first_observed").over(v), "held": F.lag("n").over(v)})
    return run.where(F.col("_ok") & ~F.col("_ok_before") & (F.col("_target_before") == F.col(target))).select(*keys, target, "first_seen", F.col("first_observed").alias("released_at"), "held")


def freshness(requests: DataFrame, keys: list[str], order: list[str], at: str, status: Column, max_age: int) -> DataFrame:
    """Requests with stored_at (of the last 200 answer before) and mode, how each is to be sent; instants in microseconds.

    ``first`` without an answer of 200 before it, ``refresh`` if that is older than max_age, else ``conditional``. An
    answer of 200 replaces what is stored, one of 304 or anything else never does.
    """
    before = by_reference(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    out = requests.withColumn("stored_at", F.max(F.when(status == 200, F.col(at))).over(before))
    age = F.col(at) - F.col("stored_at")
    return out.withColumn("mode", F.when(age.isNull(), "first").when(age > max_age, "refresh").otherwise("conditional"))
