"""The table of immutable objects: merging, lookup, healing of trees, peeling of tag chains.

A tree is trusted if it is neither empty nor its own commit nor a placeholder, and its commit isn't one either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stage

ENDS = ("commit", "tree", "blob")
#: The identifiers that stand for a commit and a tree that weren't known.
PLACEHOLDERS = ("0000000000000000000000000000000000000001", "0000000000000000000000000000000000000002")


def placeholder(sha: Column) -> Column:
    return F.coalesce(sha.isin(*PLACEHOLDERS), F.lit(False))


def trusted_tree(commit: Column, tree: Column) -> Column:
    return F.coalesce((tree != "") & (tree != commit) & ~placeholder(tree) & ~placeholder(commit), F.lit(False))


def merge(known: DataFrame, new: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key and value: what is known stays, and of a new key's values the first in order. Null keys and values are left out.

    Values that are given later are no error here; ``conflicts`` lists them. Merging in two appends, the second of
    later rows, gives what merging at once does.
    """
    rows = new.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    first = rows.groupBy(key).agg(F.min_by(value, F.struct(*order, value)).alias(value))
    return known.select(key, value).unionByName(first.join(known.select(key), key, "left_anti"))


def conflicts(merged: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, kept, other and n: values that new rows give to a key of another value, with how many rows do."""
    rows = new.groupBy(key, F.col(value).alias("other")).agg(F.count("*").alias("n"))  # a repeated value meets the table once
    both = rows.join(merged.select(key, F.col(value).alias("kept")), key)
    return both.where("kept <> other").select(key, "kept", "other", "n")


def tree_index(objects: DataFrame, order: list[str]) -> DataFrame:
    """commit_sha and tree_sha of cached commits, the first trusted tree of each; objects are in any order."""
    own = objects.where((F.col("kind") == "commit") & trusted_tree(F.col("commit_sha"), F.col("tree_sha")))
    return merge(own.limit(0).select("commit_sha", "tree_sha"), own, "commit_sha", "tree_sha", order)


def looked_up(refs: DataFrame, objects: DataFrame, target: str = "target_sha") -> DataFrame:
    """The references with kind, commit_sha and tree_sha of what they point to; unpeeled where that isn't known."""
    known = objects.select(F.col("sha").alias(target), "kind", "commit_sha", "tree_sha")
    out = refs.join(known, target, "left")
    return out.withColumn("kind", F.coalesce("kind", F.lit("unpeeled")))


def healed(bindings: DataFrame, index: DataFrame) -> DataFrame:
    """The bindings (commit_sha, tree_sha) with the index's tree where it has one, before (the own tree) and unverified before and after.

    Unverified is a tree that isn't trusted, isn't in the index or differs from it.
    """
    cached = index.select("commit_sha", F.col("tree_sha").alias("_cached"))
    out = bindings.join(cached, "commit_sha", "left").withColumn("before", F.col("tree_sha"))
    wrong = lambda tree: ~trusted_tree(F.col("commit_sha"), F.col(tree)) | ~F.coalesce(F.col(tree) == F.col("_cached"), F.lit(False))
    out = out.withColumn("tree_sha", F.coalesce("_cached", "tree_sha"))
    return out.withColumns({"unverified_before": wrong("before"), "unverified_after": wrong("tree_sha")}).drop("_cached")


def missing_trees(bindings: DataFrame, index: DataFrame) -> DataFrame:
    """Different commits of bindings that the index has no tree of."""
    return bindings.select("commit_sha").distinct().join(index, "commit_sha", "left_anti")


def peeled(tips: DataFrame, tags: DataFrame, depth: int = 8) -> DataFrame:
    """The tips (sha, kind) with peeled_sha, peeled_kind, hops (tags passed) and reason, null where an object is reached.

    tags: sha, next_sha, next_kind of each tag object, one row a sha. Chains are followed by pointer jumping: in each round a
    tag's pointer takes over its end's pointer, so a chain of n tags needs about log2(n) rounds, however
    many chains there are. Only pointers that still end in a tag take part, and each round is written.

    Reasons: ``missing object`` (a tag that isn't in the table), ``unsupported kind``, ``too deep`` (an end after more
    than ``depth`` tags, whatever it is) and ``cycle``. A tip that is no tag is its own end. Rows with a null sha or kind are unsupported.
    """
    now = stage(tags.select("sha", F.col("next_sha").alias("end"), F.coalesce("next_kind", F.lit("")).alias("kind"), F.lit(1).cast("long").alias("hops")), "pointers")
    size = now.count()
    done: list[DataFrame] = []
    reach = 1
    while True:
        done.append(now.where("kind <> 'tag'"))
        open_ = now.where("kind = 'tag'")
        if open_.isEmpty() or reach > size:
            done.append(open_.withColumn("kind", F.lit("cycle")))
            break
        # resolved pointers stay where they were written: a pointer finds its end in one of the rounds
        ends = reduce(DataFrame.unionByName, [*done, open_]).select(F.col("sha").alias("end"), F.col("end").alias("_end"), F.col("kind").alias("_kind"), F.col("hops").alias("_hops"))
        on = open_.join(ends, "end", "left")
        gone = F.col("_kind").isNull()
        now = stage(on.select("sha", F.when(gone, F.col("end")).otherwise(F.col("_end")).alias("end"), F.when(gone, F.lit("missing")).otherwise(F.col("_kind")).alias("kind"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")), "pointers")
        reach *= 2
    ends = reduce(DataFrame.unionByName, done).select("sha", F.col("end").alias("_end"), F.col("kind").alias("_kind"), F.col("hops").alias("_hops"))
    out = tips.join(ends, "sha", "left")
    c, tag = F.col, F.coalesce(F.col("kind") == "tag", F.lit(False))
    out = out.withColumns({"_kind": F.when(~tag, c("kind")).otherwise(F.coalesce("_kind", F.lit("missing"))), "_end": F.when(tag, c("_end")).otherwise(c("sha")), "_hops": F.when(tag, F.coalesce("_hops", F.lit(0))).otherwise(0)})
    reason = (
        F.when(c("_kind") == "cycle", "cycle")
        .when((c("_kind") == "missing") & (c("_hops") < depth), "missing object")
        .when((c("_hops") > depth) | (c("_kind") == "missing"), "too deep")
        .when(F.coalesce(~c("_kind").isin(*ENDS), F.lit(True)) | c("_end").isNull(), "unsupported kind")
    )
    out = out.withColumn("reason", reason)
    found = lambda x: F.when(c("reason").isNull(), c(x))
    return out.withColumns({"peeled_sha": found("_end"), "peeled_kind": found("_kind"), "hops": found("_hops")}).drop("_kind", "_end", "_hops")
