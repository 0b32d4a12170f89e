"""The hash-linked ledger: numbering, linking, gaps, daily digests, heads, first failure."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json, entry_hash
from tidemark.functions.times import micros, strict
from tidemark.sources.shared import stage

GENESIS = "sha256:" + "0" * 64


def with_row_before(rows: DataFrame, seq: str, columns: list[str], part: int = 1 << 20) -> DataFrame:
    """prev_<column> of the row with the next lower number, over the whole table.

    A window over the table would put it into one task. Here rows are windowed within parts of the
    number range, and only the last row of each part is carried over to the next.
    """
    rows = rows.withColumn("_part", F.floor(F.col(seq) / part))
    w = Window.partitionBy("_part").orderBy(seq)
    rows = rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {"_first": F.row_number().over(w) == 1})
    ends = rows.groupBy("_part").agg(F.max_by(F.struct(*columns), seq).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.orderBy("_part"))).select("_part", "_before")
    out = rows.join(ends, "_part")
    return out.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")) for c in columns}).drop("_part", "_first", "_before")


def gaps(rows: DataFrame, seq: str) -> DataFrame:
    """Rows whose number doesn't follow on that of the row before."""
    out = with_row_before(rows.select(seq), seq, [seq])
    return out.where(F.col(seq) != F.col(f"prev_{seq}") + 1).select(F.col(f"prev_{seq}").alias("last_seq"), F.col(seq).alias("next_seq"), (F.col(seq) - F.col(f"prev_{seq}") - 1).alias("missing"))


def numbered(rows: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """The rows with seq, gapless from a number on: sorted in ranges, each of which begins after the counts of those before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged, "ranged")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row a range
    at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + F.lit(first).cast("long")
    return ranged.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn("seq", at).drop("_part", "_at", "_before")


def link(rows: DataFrame, order: list[str], tip: tuple[int, str] = (-1, GENESIS), drop: list[str] | tuple = ()) -> DataFrame:
    """seq, prev_hash and entry_hash of new rows after a tip (its number and hash), as violations() checks them.

    The hash is over the canonical row with seq and prev_hash inside, so each needs the one before: for
    the rows of one append this is one task by nature, which holds a batch of rows at a time. Checking a ledger needs none
    of it. The hashes go back to their rows by a merge join: Spark takes them for small, as a whole row is wide, and
    would broadcast them over the driver. Columns to drop only order the rows.
    """
    rows = rows.drop("seq", "prev_hash", "entry_hash")
    names = [c for c in rows.columns if c not in drop]
    rows = numbered(rows, order, tip[0] + 1)
    texts = rows.select(*names, "seq")
    inner = lambda columns: F.expr("substring(_t, 2, length(_t) - 2)") if columns else F.lit("")
    for name, some in (("_head", [c for c in names if c < "prev_hash"]), ("_tail", [c for c in [*names, "seq"] if c > "prev_hash"])):
        texts = texts.withColumn("_t", canonical_json(texts, some)).withColumn(name, inner(some)).drop("_t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = tip[1]
        for batch in batches:
            before, own = [], []
            for head, tail in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                before.append(now)
                text = ",".join(x for x in (head, f'"prev_hash":"{now}"', tail) if x)
                now = "sha256:" + hashlib.sha256(f"{{{text}}}".encode()).hexdigest()
                own.append(now)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.string()), pa.array(own, pa.string())], ["seq", "prev_hash", "entry_hash"])

    chain = texts.select("seq", "_head", "_tail").repartition(1).sortWithinPartitions("seq")
    hashes = chain.mapInArrow(fold, "seq long, prev_hash string, entry_hash string")
    return rows.select(*names, "seq").join(hashes.hint("merge"), "seq").select(*names, "seq", "prev_hash", "entry_hash")


def violations(ledger: DataFrame) -> DataFrame:
    """seq, rank and what of every row that breaks a rule: version, those of its event, number, hash or link.

    A row's hash needs only the row, and its link only the row before, so nothing is folded.
    """
    checked = with_row_before(ledger.withColumn("_own", entry_hash(ledger)), "seq", ["seq", "entry_hash"])
    first = F.col("prev_seq").isNull()
    rules = [
        (F.col("format_version") != 1, F.lit("format version")),
        *((bad, F.lit(name)) for name, bad in ledger_problems().items()),
        (~first & (F.col("seq") != F.col("prev_seq") + 1), F.concat(F.lit("sequence gap at seq "), (F.col("prev_seq") + 1).cast("string"))),
        (F.col("entry_hash").isNull() | (F.col("entry_hash") != F.col("_own")), F.lit("hash mismatch")),
        (F.when(first, (F.col("seq") == 0) & (F.col("prev_hash") != GENESIS)).otherwise(F.col("prev_hash") != F.col("prev_entry_hash")), F.lit("broken link")),
    ]
    rules = [(rank, *rule) for rank, rule in enumerate(rules, 1)]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rank).alias("rank"), what.alias("what"))) for rank, bad, what in rules]), lambda x: x.isNotNull())
    return checked.select("seq", F.explode(found).alias("v")).select("seq", "v.rank", "v.what")


def first_failure(found: DataFrame) -> DataFrame:
    return found.orderBy("seq", "rank").limit(1)


def verdict(ledger: DataFrame) -> DataFrame:
    """One row: entries, first and last number, span, coverage, and the first violation if there is one."""
    digest = F.col("observation_digest")
    span = ledger.agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.coalesce(F.sum(digest["skipped"]), F.lit(0)).alias("skipped"), F.coalesce(F.sum(digest["failed"]), F.lit(0)).alias("failed"))
    bad = first_failure(violations(ledger)).agg(F.first("seq").alias("bad_seq"), F.first("what").alias("failure"))
    return span.join(bad, F.lit(True), "left").withColumn("valid", F.col("failure").isNull())


def daily_digest(rows: DataFrame, day: Column, group: str, outcome: Column) -> DataFrame:
    """Counts of each day by outcome; days without any row between the first and the last have zeros."""
    rows = rows.withColumn("day", day)
    counted = rows.groupBy("day").agg(F.count_distinct(group).alias("repos_polled"), *[F.count_if(outcome == x).alias(x) for x in ("ok", "not_modified", "failed", "skipped")])
    span = counted.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counted, "day", "left").na.fill(0)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def disagreeing(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows don't all have the same values, with how many different ones."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("different")).where("different > 1")


def backlog(rows: DataFrame, at: str, hours: int, open_: Column) -> DataFrame:
    """Open rows that are older than so many hours before the table's last instant (microseconds)."""
    last = rows.agg(F.max(at).alias("_last"))
    return rows.where(open_).join(F.broadcast(last)).where(F.col(at) <= F.col("_last") - hours * 3_600_000_000).drop("_last")


def stable_days(first: Column, last: Column) -> Column:
    """Whole days between two instants in microseconds, 0 without a last one."""
    return F.coalesce(F.greatest(F.floor((last - first) / 86_400_000_000), F.lit(0)), F.lit(0)).cast("long")


def entry_problems(members: str = "member_seqs") -> dict[str, Column]:
    """Rules for rows of a ledger's plain columns by event, as names and violated conditions."""
    c = F.col
    bound = c("event").isin("move", "deletion", "recreation")
    return {
        "binding missing": bound & (c("from").isNull() | c("to").isNull()),
        "classification or severity missing": bound & (c("classification").isNull() | c("severity").isNull()),
        "window not positive": bound & ~F.coalesce(c("observation_window_seconds") > 0, F.lit(False)),
        "fewer than two sources": bound & (F.coalesce(F.size("source_observations"), F.lit(0)) < 2),
        "gap missing": (c("event") == "recreation") & c("gap_seconds").isNull(),
        "correlation empty": (c("event") == "correlation") & (F.coalesce(F.size(c(members)), F.lit(0)) < 1),
        "correlation member not before its row": (c("event") == "correlation") & F.exists(F.coalesce(members, F.array().cast("array<bigint>")), lambda m: m >= c("seq")),
        "status missing": c("event").isin("repo_unavailable", "repo_redirected") & c("http_status").isNull(),
        "location missing": (c("event") == "repo_redirected") & c("redirect_location").isNull(),
        "correction without target or reason": (c("event") == "correction") & (c("corrects_seq").isNull() | c("reason").isNull()),
    }


def ledger_problems() -> dict[str, Column]:
    """All rules for rows of the schema ENTRY, those of payloads and bindings included."""
    c = F.col
    digest, change = c("event") == "observation_digest", c("event") == "population_change"
    paths = c("observation_digest.files.path")

    def unstable(side: str) -> Column:
        days = stable_days(micros(strict(c(f"{side}.first_observed"))), micros(strict(c(f"{side}.last_observed"))))
        return c(side).isNotNull() & ~c(f"{side}.stable_days").eqNullSafe(days)

    return entry_problems("correlation.member_seqs") | {
        "correlation without batch": (c("event") == "correlation") & (F.coalesce(F.length("correlation.batch_id"), F.lit(0)) < 1),
        "digest missing": digest & (c("observation_digest").isNull() | paths.isNull()),
        "digest files out of order": digest & ~paths.eqNullSafe(F.array_sort(paths)),
        "digest date not of 10 characters": digest & ~F.coalesce(F.octet_length("observation_digest.date") == 10, F.lit(False)),
        "population change without repository or payload": change & (c("repo").isNull() | c("population_change").isNull()),
        "transitive reason without a source at a commit": change & (c("population_change.reason.type") == "transitive") & ~F.coalesce(F.contains(c("population_change.reason.via"), F.lit("@")), F.lit(False)),
        "correction with diff": (c("event") == "correction") & c("diff").isNotNull(),
        "stable days not those of the binding": unstable("from") | unstable("to"),
    }


def observation_problems() -> dict[str, Column]:
    """Rules for rows of the schema OBSERVATION."""
    limited = (F.col("outcome.type") == "failed") & F.col("outcome.http_status").isin(403, 429)
    return {"limit event missing": limited & F.col("secondary_limit_observed").isNull()}


def problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with problems, the names of the rules that they break."""
    names = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("problems", names)
