"""The watched population: poll groups, closure over uses, registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stage


def poll_groups(watched: DataFrame, repo: str, path: str) -> DataFrame:
    """Sorted different paths of each repository; no path counts as one, first in order."""
    paths = F.array_sort(F.collect_set(F.struct(F.col(path).alias("path"))), lambda a, b: F.when(a["path"].isNull(), F.when(b["path"].isNull(), 0).otherwise(-1)).when(b["path"].isNull(), 1).when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return watched.groupBy(repo).agg(F.transform(paths, lambda x: x["path"]).alias("paths"))


def closure(seeds: DataFrame, edges: DataFrame, depth: int, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes reached from the seeds in at most so many steps, with the least number of steps.

    One join per step, whose rows are written to the shared folder: each step reads the edges and the
    steps before once. A visited node is not followed again, and it ends early if nothing new is found.
    """
    steps = stage(edges.select(src, dst).distinct(), "edges")
    seen = front = stage(seeds.select(node).distinct().withColumn("depth", F.lit(0)), "seeds")
    for k in range(1, depth + 1):
        found = front.join(steps, front[node] == steps[src]).select(F.col(dst).alias(node)).distinct()
        front = stage(found.join(seen.select(node), node, "left_anti").withColumn("depth", F.lit(k)), "step")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure_with_paths(seeds: DataFrame, edges: DataFrame, depth: int, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """The nodes of ``closure`` with depth and path: one shortest chain from a seed, through the smallest parent at each step.

    A step keeps one path for each new node, so what is carried grows with the nodes reached and not with the
    number of chains between them.
    """
    steps = stage(edges.select(src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct(), "edges")
    seen = front = stage(seeds.select(node).distinct().withColumns({"depth": F.lit(0), "path": F.array(node)}), "seeds")
    for k in range(1, depth + 1):
        found = front.join(steps, front[node] == steps[src]).groupBy(dst).agg(F.min_by("path", src).alias("_p"))
        found = found.select(F.col(dst).alias(node), F.lit(k).alias("depth"), F.concat("_p", F.array(dst)).alias("path"))
        front = stage(found.join(seen.select(node), node, "left_anti"), "step")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def within_budget(rows: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows with spent (their cost and that of all before them in the order), as far as that is within the budget.

    The order is a range-partitioned sort, which is written; its parts' sums, one row a part, say where each
    begins, and only the rows of the part in which the budget ends are left to the running sum's filter. The
    order should end in something unique, or ties fall as they are sorted.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sums = placed.groupBy("_part").agg(F.sum(cost).alias("_sum"))
    begins = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    open_ = placed.join(F.broadcast(begins.where(F.col("_before") <= budget)), "_part")  # one row a part
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return open_.withColumn("spent", F.col("_before") + F.sum(cost).over(own)).where(F.col("spent") <= budget).drop("_part", "_at", "_before")


def priority_peels(refs: DataFrame, state: DataFrame, index: DataFrame) -> DataFrame:
    """Listed references (repo, ref, target) that must be resolved first, with why and prior_sha, the old object to resolve too.

    state, one row a reference: tombstoned, prior_target, bound_target, bound_commit, bound_tree (null where there is
    none), pending_to. Why is the first of: it was deleted before (``recreated``), its target isn't the prior one, or the
    bound one where there is no prior (``moved``), or an unresolved move to this target is open (``pending``). The
    old object is the prior target of a reference without a binding, or the bound commit whose
    tree is itself and not in the index (commit_sha).
    """
    c = F.col
    known = index.select(c("commit_sha").alias("bound_commit"), F.lit(True).alias("_cached")).distinct()
    rows = refs.join(state, ["repo", "ref"]).join(known, "bound_commit", "left")
    moved = F.coalesce(c("prior_target"), c("bound_target")) != c("target")
    why = F.when(c("tombstoned"), "recreated").when(moved, "moved").when(c("pending_to") == c("target"), "pending")
    invented = (c("bound_tree") == c("bound_commit")) & c("_cached").isNull()
    old = F.when(c("bound_target").isNull(), c("prior_target")).when(invented, c("bound_commit"))
    return rows.withColumn("why", why).where("why is not null").select("repo", "ref", "target", "why", F.when(c("why") != "recreated", old).alias("prior_sha"))


def cut_off(reached: DataFrame, edges: DataFrame, depth: int, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges out of nodes at the greatest depth to nodes that are not reached, one row each."""
    last = reached.where(F.col("depth") == depth).select(F.col(node).alias(src))
    return edges.join(last, src, "left_semi").join(reached.select(F.col(node).alias(dst)), dst, "left_anti")


def earliest(rows: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct(at, id_)).alias("_e")).select(*keys, F.col(f"_e.{at}").alias(at), F.col(f"_e.{id_}").alias(id_))


def registrations(watched: DataFrame, seen: DataFrame, added: DataFrame, repo: str, path: str, at: str, id_: str) -> DataFrame:
    """Watched keys that are not added yet, with their earliest observation, or their repository's.

    Keys that were never observed wait. ``seen`` has the earliest observation of each key.
    """
    key = lambda a, b: a[repo].eqNullSafe(b[repo]) & a[path].eqNullSafe(b[path])
    new = watched.join(added, key(watched, added), "left_anti")
    exact = seen.select(F.col(repo).alias("_r"), F.col(path).alias("_p"), F.struct(at, id_).alias("_own"))
    of_repo = seen.groupBy(F.col(repo).alias("_rr")).agg(F.min(F.struct(at, id_)).alias("_any"))
    out = new.join(exact, new[repo].eqNullSafe(exact["_r"]) & new[path].eqNullSafe(exact["_p"]), "left").join(of_repo, new[repo] == of_repo["_rr"], "left")
    first = F.coalesce("_own", "_any")
    return out.withColumn("_f", first).where("_f is not null").select(*[new[c] for c in watched.columns], F.col(f"_f.{at}").alias(at), F.col(f"_f.{id_}").alias(id_))


def throttle_reading(first_a: Column, first_b: Column, step: Column) -> Column:
    """What the rates at which two modes were first refused say about how requests are counted."""
    return (
        F.when(first_a.isNull() & first_b.isNull(), "not reached")
        .when(first_a.isNull() | first_b.isNull(), "incomplete")
        .when(F.abs(first_a - first_b) <= step, "per template")
        .when(first_a > first_b + step, "per address")
        .otherwise("ambiguous")
    )
