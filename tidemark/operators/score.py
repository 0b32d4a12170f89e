"""Detection quality: recorded gaps, eligibility, first matches after an action, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stage

EXPECTED = ("floating_major_forward", "exact_content_change", "commit_metadata_only", "lightweight_to_annotated", "annotated_to_lightweight", "delete", "recreate", "batch_exact_to_one")
RETIRED = ("lightweight_annotated_roundtrip", "delete_recreate")
CREATION = ("bootstrap", "creation", "create")


def recorded_gaps(rows: DataFrame, keys: list[str], at: str, kind: Column) -> DataFrame:
    """Closed intervals of no coverage: a backoff lasts to the next observation, a lag from the one before.

    Neighbours are strictly later or earlier, so equal instants are first made one.
    """
    instants = rows.select(*keys, at).distinct()
    w = Window.partitionBy(*keys).orderBy(at)
    near = instants.withColumns({"_next": F.lead(at).over(w), "_before": F.lag(at).over(w)})
    skips = rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).join(near, [*keys, at])
    lag = F.col("kind") == "scheduler_lag"
    return skips.withColumns({"gap_from": F.when(lag, F.coalesce("_before", at)).otherwise(F.col(at)), "gap_to": F.when(lag, F.col(at)).otherwise(F.coalesce("_next", at))}).drop("_next", "_before")


def first_covering(actions: DataFrame, gaps: DataFrame, keys: list[str], at: str, span: int, action_id: str, tie: list[str]) -> DataFrame:
    """Each action with the first gap that holds it, if there is one.

    Gaps are cut into cells of the span, so that actions meet only gaps of their own cell: an equality
    join whatever the number of gaps of a key. ``at`` and the gaps are in microseconds.
    """
    cell = lambda c: F.floor(F.col(c) / span)
    cells = gaps.withColumn("_cell", F.explode(F.sequence(cell("gap_from"), cell("gap_to"))))
    held = actions.withColumn("_cell", cell(at)).join(cells, [*keys, "_cell"]).where((F.col(at) >= F.col("gap_from")) & (F.col(at) <= F.col("gap_to")))
    chosen = held.groupBy(action_id).agg(F.min(F.struct("gap_from", *tie, "gap_to", "kind")).alias("_g")).select(action_id, "_g.gap_from", "_g.gap_to", "_g.kind")
    return actions.join(chosen, action_id, "left")


def first_after(actions: DataFrame, events: DataFrame, on: list[str], at: str, event_at: str, columns: list[str], tie: list[str], span: int = 86_400_000_000) -> DataFrame:
    """Each action with the first event of its keys that isn't earlier; actions without one drop out.

    Both are put in one order, backwards, in which the event last passed is the next one in time. A key
    is cut into cells of the span (microseconds), and an action after its cell's last event takes the
    first of the next cell that has one: no key is in one task, and no event meets every action.
    """
    cell = lambda c: F.floor(F.col(c) / span).alias("_cell")
    some = F.lit(True)
    for k in on:
        some = some & F.col(k).isNotNull()
    event = F.struct(event_at, *tie, *[c for c in columns if c not in tie])
    ends = stage(events.where(some & F.col(event_at).isNotNull()).select(*on, cell(event_at), F.col(event_at).alias("_at"), event.alias("_e")), "events")
    acts = actions.where(some & F.col(at).isNotNull()).select(*on, cell(at), F.col(at).alias("_at"), F.struct(*actions.columns).alias("_a"))
    both = acts.unionByName(ends, allowMissingColumns=True)
    back = Window.partitionBy(*on, "_cell").orderBy(F.col("_at").desc(), F.col("_a").isNotNull(), F.col("_e").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_own", F.last("_e", ignorenulls=True).over(back)).where("_a is not null")
    cells = ends.groupBy(*on, "_cell").agg(F.min("_e").alias("_f")).unionByName(acts.select(*on, "_cell").distinct(), allowMissingColumns=True)
    cells = cells.groupBy(*on, "_cell").agg(F.min("_f").alias("_f"))
    after = Window.partitionBy(*on).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_next", F.last("_f", ignorenulls=True).over(after)).select(*on, "_cell", "_next")
    found = inside.join(cells, [*on, "_cell"]).withColumn("_e", F.coalesce("_own", "_next")).where("_e is not null")
    return found.select("_a.*", F.col(f"_e.{event_at}").alias(event_at), *[F.col(f"_e.{c}").alias(c) for c in columns])


def latency_seconds(performed: Column, observed: Column) -> Column:
    """Whole seconds, at least 0; instants in microseconds."""
    return F.greatest(F.floor((observed - performed) / 1_000_000), F.lit(0)).cast("long")


def floor_percentiles(values: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """One row of n and the values at index p * (n - 1) div 100 of the sorted ones, named p<percent>.

    Found by counting equal values, not by collecting them: running sums over the distinct values,
    first of their ranges and then within the range that holds the index.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    coarse = counts.groupBy(F.floor(F.col(value) / 4096).alias("_range")).agg(F.sum("_n").alias("_m"))
    start = coarse.withColumn("_start", F.sum("_m").over(Window.orderBy("_range")) - F.col("_m"))
    total = F.sum("_m").over(Window.partitionBy())
    start = start.withColumn("_total", total).select("_range", "_start", "_total")
    w = Window.partitionBy("_range").orderBy(value)
    placed = counts.withColumn("_range", F.floor(F.col(value) / 4096)).join(start, "_range").withColumn("_through", F.col("_start") + F.sum("_n").over(w))
    at = lambda p: F.floor(F.lit(p) * (F.col("_total") - 1) / 100)
    return placed.agg(F.coalesce(F.max("_total"), F.lit(0)).alias("n"), *[F.min(F.when(F.col("_through") > at(p), F.col(value))).alias(f"p{p}") for p in percents])


def bucket(manual: Column, pattern: Column, performed: Column, added: Column, in_gap: Column, detected: Column, right: Column) -> Column:
    """The bucket of an action, the first that applies."""
    return (
        F.when(manual, "manual")
        .when(pattern.isin(*RETIRED), "retired")
        .when(pattern.isin(*CREATION) | ~pattern.isin(*EXPECTED), "creation")
        .when(performed.isNull() | added.isNull() | (performed <= added), "pre_genesis")
        .when(in_gap, "during_gap")
        .when(~detected, "missed")
        .when(~right, "misclassified")
        .otherwise("detected")
    )
