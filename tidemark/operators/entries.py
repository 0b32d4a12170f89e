"""Ledger rows from what was observed: events of references and repositories, diffs, and batches.

The rows have the columns of the schema ENTRY but for seq, prev_hash and entry_hash, which
``ledger.link`` adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import refs, times
from tidemark.operators import classify, ledger, listings
from tidemark.sources import schemas

LINKS = ("seq", "prev_hash", "entry_hash")
#: Events of a reference's binding.
BOUND = ("move", "deletion", "recreation")


def classification(event: Column, kind: Column, same_target: Column) -> Column:
    """The kind of a move; a recreation is a change of content unless it came back as it was, a deletion always."""
    again = F.when(same_target, "release_level_only").otherwise("content_change")
    return F.when(event == "move", kind).when(event == "recreation", again).when(event == "deletion", "content_change")


def repository_events(polls: DataFrame) -> DataFrame:
    """What failed polls (OBSERVATION) say of a repository: 301 and 302 that it moved, 404 that it is not there.

    Other failures, and skipped or unchanged polls, say nothing. A redirect without a location has an empty one.
    """
    status = F.col("outcome.http_status")
    event = F.when(status.isin(301, 302), "repo_redirected").when(status == 404, "repo_unavailable")
    found = polls.where("outcome.type = 'failed'").withColumn("event", event).where("event is not null")
    location = F.when(F.col("event") == "repo_redirected", F.coalesce("redirect_location", F.lit("")))
    return found.select("event", "repo", F.col("observed_at").alias("recorded_at"), status.alias("http_status"), location.alias("redirect_location"))


def event_rank(event: Column) -> Column:
    """The order of events of one observation: the repository's, then deletions, recreations and moves (each by reference)."""
    order = ("repo_unavailable", "repo_redirected", "deletion", "recreation", "move")
    return F.coalesce(*[F.when(event == e, F.lit(k)) for k, e in enumerate(order)], F.lit(len(order)))


def entries(events: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """Rows of events that have some of ENTRY's columns, and kind where they are moves.

    diffs (old_sha, new_sha, diff), one row a pair, gives moves the diff of their two commits.
    """
    names = set(events.columns)
    if "from" in names:
        same = F.col("from.target_sha") == F.col("to.target_sha")
        events = events.withColumn("classification", classification(F.col("event"), F.col("kind") if "kind" in names else F.lit(None), same))
        names.add("classification")
        if diffs is not None:
            pair = (F.col("event") == "move") & (F.col("from.commit_sha") == F.col("old_sha")) & (F.col("to.commit_sha") == F.col("new_sha"))
            events = events.join(diffs.select("old_sha", "new_sha", "diff"), pair, "left")
            names.add("diff")
    whole = events.withColumn("format_version", F.lit(1))
    kinds = events.sparkSession.createDataFrame([], schemas.ENTRY).schema
    return whole.select(*[(F.col(f"`{f.name}`") if f.name in names | {"format_version"} else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds if f.name not in LINKS])


def of_listings(events: DataFrame, tree_of: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``listings.bound_events``, whole: bindings with counts and stable days, sources, windows, kind and severity.

    tree_of gives the tree of a commit. Moves have no ancestry or correlation yet; both raise the severity.
    """
    c = F.col
    form = refs.ref_form(c("ref"))
    kind = classify.move_kind(c("from.target"), c("to.target"), tree_of(c("from.target")), tree_of(c("to.target")))
    moved = classify.severity(form, kind, F.lit(None).cast("string"), F.lit(False))
    again = listings.severity_of_recreation(c("from.target"), c("to.target"))
    severity = F.when(c("event") == "deletion", "info").when(c("event") == "recreation", again).otherwise(moved)

    def binding(side: str) -> Column:
        sha, first, last = c(f"{side}.target").cast("string"), c(f"{side}.first_us"), c(f"{side}.last_us")
        wire = lambda us: times.wire(F.timestamp_micros(us))
        days = ledger.stable_days(times.micros(times.strict(wire(first))), times.micros(times.strict(wire(last))))
        fields = {"action_yml_sha": F.lit(None).cast("string"), "commit_sha": sha, "first_observed": wire(first), "last_observed": wire(last), "observation_count": c(f"{side}.observation_count"), "stable_days": days, "target_sha": sha, "tree_sha": tree_of(c(f"{side}.target")).cast("string")}
        return F.struct(*[x.alias(n) for n, x in fields.items()])

    rows = events.select("event", c("repo").cast("string").alias("repo"), "ref", kind.alias("kind"), form.alias("ref_form"), severity.alias("severity"), times.wire(F.timestamp_micros("us")).alias("recorded_at"), "gap_seconds", c("window_seconds").alias("observation_window_seconds"), c("sources").alias("source_observations"), binding("from").alias("from"), binding("to").alias("to"))
    return entries(rows)


def digests(days: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """Digest rows of days (date, repos_polled and counts), each at the beginning of the day after.

    files (date, path, sha256) are listed by path; a path that is there twice on a day is an error. notes (date,
    note) are sorted and joined; a note that an earlier day has is left out. Days without files have an empty list.
    """
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    twice = F.raise_error(F.concat(F.lit("a path twice on "), F.col("date"))).cast("boolean")
    files = files.groupBy("date").agg(listed.alias("files"), F.count_distinct("path").alias("_n"))
    files = files.where(F.when(F.size("files") == F.col("_n"), F.lit(True)).otherwise(twice)).drop("_n")
    once = notes.where("note <> ''").groupBy("note").agg(F.min("date").alias("date"))
    once = once.groupBy("date").agg(F.array_join(F.array_sort(F.collect_list("note")), "; ").alias("note"))
    kind = days.sparkSession.createDataFrame([], schemas.ENTRY).schema["observation_digest"].dataType
    whole = days.join(files, "date", "left").join(once, "date", "left")
    files_of = F.coalesce("files", F.array().cast(kind["files"].dataType))
    payload = F.struct(*[(files_of if f.name == "files" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in kind])
    after = F.concat(F.date_format(F.date_add(F.to_date("date"), 1), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    return entries(whole.select(F.lit("observation_digest").alias("event"), after.alias("recorded_at"), payload.alias("observation_digest")))


def correlations(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of batches (repo, recorded_at, batch_id, refs, all_to_same_target, note) over linked rows.

    A member is the last row of its reference that changed it, at the batch's instant or before: later rows of
    the ledger are no members, so a batch that is derived again gives the same row. A batch is one row however
    often it is given, by its last instant; a reference without such a row is an error, as nothing could name it.
    """
    once = batches.groupBy("repo", "batch_id").agg(F.max_by(F.struct("recorded_at", "refs", "all_to_same_target", "note"), "recorded_at").alias("_b")).select("repo", "batch_id", "_b.*")
    asked = once.select("repo", F.explode(F.array_distinct("refs")).alias("ref"), "recorded_at", "batch_id")
    rows = rows.where(F.col("event").isin(*BOUND)).select("repo", "ref", "recorded_at", "seq")
    # one order of both in place of a join of each batch with all rows of its references: rows first, then who asks
    both = rows.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("repo", "ref").orderBy("recorded_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    member = both.withColumn("seq", F.max("seq").over(upto)).where("batch_id is not null")
    refused = F.raise_error(F.concat(F.lit("no row of "), F.col("ref"))).cast("long")
    member = member.groupBy("repo", "batch_id").agg(F.array_sort(F.collect_set(F.coalesce("seq", refused))).alias("member_seqs"))
    payload = F.struct("all_to_same_target", "batch_id", "member_seqs", "note", F.col("refs").alias("refs_moved_together"))
    return entries(once.join(member, ["repo", "batch_id"]).select(F.lit("correlation").alias("event"), "repo", "recorded_at", payload.alias("correlation")))


def not_sourced(observations: DataFrame, rows: DataFrame) -> DataFrame:
    """The ok observations later than the ledger's last row that no move, deletion or recreation names as a source.

    They are what to derive from after a stop. An empty ledger has no last row and gives none; other polls,
    and what other rows name, don't count.
    """
    tip = rows.agg(F.max("recorded_at").alias("_tip"))  # one row
    used = rows.where(F.col("event").isin(*BOUND)).select(F.explode("source_observations").alias("observation_id")).distinct()
    left = observations.where("outcome.type = 'ok'").join(used, "observation_id", "left_anti").join(F.broadcast(tip))
    return left.where(F.col("observed_at") > F.col("_tip")).drop("_tip")


def recovered(observations: DataFrame, rows: DataFrame) -> DataFrame:
    """observation_id and EVENT columns of what a stop lost: the changes at observations that are not sourced.

    observations: OBSERVATION rows that also have us, names and commits of an ok listing. Each is
    compared with the latest ok listing before it, sourced or not, and what was gone before that
    counts for recreations.
    """
    ok = observations.where("outcome.type = 'ok'")
    lost = not_sourced(observations, rows).select("repo", "us", "observation_id")
    return listings.changes(ok.select("repo", "us", "names", "commits")).join(lost, ["repo", "us"])
