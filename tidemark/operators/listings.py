"""Changes between full listings of a repository's references.

A listing says which references exist: absence from one that succeeded is a deletion, and a failed or
unchanged poll says nothing about absence. The first listing of a repository emits nothing, nor does a
reference's first appearance.

Listings are numbered once, each knowing the next one's instant; after that every row is compared with its
reference's own previous and next row in one window, so no grid of references and listings is built and nothing is
read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "repo long, us long, event string, ref string, from_commit long, to_commit long, seconds long"


def seconds(a: Column, b: Column) -> Column:
    return F.floor((b - a) / 1_000_000).cast("long")


def snapshot(target: Column, first: Column, last: Column, count: Column) -> Column:
    """What a binding is at an instant: target, first and last instant in microseconds, and observation_count."""
    return F.struct(target.alias("target"), first.cast("long").alias("first_us"), last.cast("long").alias("last_us"), count.cast("long").alias("observation_count"))


def bound_events(listings: DataFrame, name: str = "observation_id") -> DataFrame:
    """repo, us, event, ref, from and to (snapshots), window_seconds, gap_seconds and sources of every move, deletion and recreation.

    Listings have repo, us, a name each, names and commits. A binding begins where a reference is first seen or
    moves; a recreated one goes on with the first instant and count that it had, whatever its target is. What a
    deletion leads to is the same target, of that instant and of no observation. The window is the time since the
    reference was last seen, the gap that since the listing that lacked it. Sources are the listings before and at the event, of
    a recreation the one before the deletion and its own.
    """
    c, of_repo = F.col, Window.partitionBy("repo").orderBy("us")
    clock = listings.select("repo", "us", c(name).alias("id"), "names", "commits").withColumns({"n": F.row_number().over(of_repo), "next_us": F.lead("us").over(of_repo), "next_id": F.lead("id").over(of_repo)})
    present = clock.withColumn("_r", F.explode(F.arrays_zip("names", "commits"))).select("repo", c("_r.names").alias("ref"), "n", "us", "id", "next_us", "next_id", c("_r.commits").alias("commit"))
    w = Window.partitionBy("repo", "ref").orderBy("n")
    before = lambda x: F.lag(x).over(w)
    seen = present.withColumns({"pn": before("n"), "pus": before("us"), "pid": before("id"), "pc": before("commit"), "gone_us": before("next_us"), "nn": F.lead("n").over(w)})
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = (c("pn") == c("n") - 1) & (c("pc") != c("commit"))
    seen = seen.withColumn("binding", F.sum(F.when(c("pn").isNull() | moved, 1).otherwise(0)).over(upto))
    own = Window.partitionBy("repo", "ref", "binding").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"first_us": F.min("us").over(own), "count": F.count("*").over(own)})
    seen = seen.withColumns({"pfirst": before("first_us"), "pcount": before("count")})
    was, now = snapshot(c("pc"), c("pfirst"), c("pus"), c("pcount")), snapshot(c("commit"), c("first_us"), c("us"), c("count"))
    none, long = F.lit(None).cast("long"), lambda x: x.cast("long")

    def event(which: str, at: Column, old: Column, new: Column, window: Column, gap: Column, sources: Column) -> Column:
        return F.struct(long(at).alias("us"), F.lit(which).alias("event"), old.alias("from"), new.alias("to"), window.alias("window_seconds"), gap.alias("gap_seconds"), sources.alias("sources"))

    found = F.array(
        F.when(moved, event("move", c("us"), was, now, seconds(c("pus"), c("us")), none, F.array("pid", "id"))),
        F.when(c("pn") < c("n") - 1, event("recreation", c("us"), was, now, seconds(c("pus"), c("us")), seconds(c("gone_us"), c("us")), F.array("pid", "id"))),
        F.when(
            c("next_us").isNotNull() & (c("nn").isNull() | (c("nn") > c("n") + 1)),
            event("deletion", c("next_us"), now, snapshot(c("commit"), c("next_us"), c("next_us"), F.lit(0)), seconds(c("us"), c("next_us")), none, F.array("id", "next_id")),
        ),
    )
    return seen.select("repo", "ref", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_e")).select("repo", "ref", "_e.*")


def changes(listings: DataFrame) -> DataFrame:
    """move, deletion and recreation rows (EVENT) from rows of repo, us, names, commits.

    seconds is the window in which a move happened, or for how long a recreated reference was gone.
    """
    c = F.col
    rows = bound_events(listings.withColumn("_id", F.lit(0)), "_id")
    time = F.when(c("event") == "move", c("window_seconds")).when(c("event") == "recreation", c("gap_seconds"))
    return rows.select("repo", "us", "event", "ref", c("from.target").alias("from_commit"), c("to.target").alias("to_commit"), time.alias("seconds"))


def severity_of_recreation(from_commit, to_commit):
    """info if it came back as it was, else medium."""
    return F.when(from_commit == to_commit, "info").otherwise("medium")
