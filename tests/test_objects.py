"""Object tables, tag chains, plans under a budget, paths, freshness."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bindings, listings, objects, population


def test_merging_in_two_appends_equals_one(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(20)}", rng.choice(["t1", "t2", None]), k) for k in range(200)] + [(None, "t1", 0)]
    df = spark.createDataFrame(rows, "commit_sha string, tree_sha string, at long")
    none = df.limit(0)
    whole = objects.merge(none, df, "commit_sha", "tree_sha", ["at"])
    parts = objects.merge(objects.merge(none, df.where("at < 90"), "commit_sha", "tree_sha", ["at"]), df.where("at >= 90"), "commit_sha", "tree_sha", ["at"])
    first = {}
    for c, t, _ in sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[2]):
        first.setdefault(c, t)
    assert dict(whole.collect()) == dict(parts.collect()) == first
    wrong = {(r.commit_sha, r.other): r.n for r in objects.conflicts(whole, df, "commit_sha", "tree_sha").collect()}
    assert sum(wrong.values()) == sum(t is not None and c is not None and t != first[c] for c, t, _ in rows) and all(first[c] != t for c, t in wrong)


def test_trees_that_are_not_trusted(spark):
    rows = [("c1", "t1"), ("c1", "c1"), ("c2", ""), ("c3", objects.PLACEHOLDERS[1]), (objects.PLACEHOLDERS[0], "t1"), ("c4", None), ("c5", "t5"), ("c6", "t6")]
    df = spark.createDataFrame([("commit", c, t, k) for k, (c, t) in enumerate(rows)] + [("tree", "x", "y", 99)], "kind string, commit_sha string, tree_sha string, at long")
    index = objects.tree_index(df.where("commit_sha <> 'c6'"), ["at"])
    assert sorted(map(tuple, index.collect())) == [("c1", "t1"), ("c5", "t5")]
    got = {(r.commit_sha, r.before): (r.tree_sha, r.unverified_before, r.unverified_after) for r in objects.healed(df.where("kind = 'commit'").select("commit_sha", "tree_sha"), index).collect()}
    assert got["c1", "t1"] == ("t1", False, False) and got["c1", "c1"] == ("t1", True, False) and got["c6", "t6"] == ("t6", True, True) and got["c4", None] == (None, True, True)
    assert sorted(r[0] for r in objects.missing_trees(df.where("kind = 'commit'"), index).collect()) == sorted(["c2", "c3", "c4", "c6", objects.PLACEHOLDERS[0]])
    cache = spark.createDataFrame([("s1", "commit", "c1", "t1")], "sha string, kind string, commit_sha string, tree_sha string")
    seen = objects.looked_up(spark.createDataFrame([("v1", "s1"), ("v2", "s2"), ("v3", None)], "name string, target_sha string"), cache)
    assert sorted((r.name, r.kind, r.tree_sha) for r in seen.collect()) == [("v1", "commit", "t1"), ("v2", "unpeeled", None), ("v3", "unpeeled", None)]


def plain_peel(sha, kind, tags, depth=8):
    seen, hops = set(), 0
    while kind == "tag":
        if sha in seen:
            return None, "cycle"
        seen.add(sha)
        if sha not in tags:
            return None, "missing object" if hops < depth else "too deep"
        hops += 1
        sha, kind = tags[sha]
    if hops > depth:
        return None, "too deep"
    return ((sha, kind, hops), None) if kind in ("commit", "tree", "blob") and sha is not None else (None, "unsupported kind")


@pytest.mark.parametrize("seed", range(3))
def test_tag_chains(spark, seed):
    rng = random.Random(seed)
    tags = {f"t{k}": (f"t{k - 1}", "tag") for k in range(1, 30)} | {"t0": ("c", "commit")}
    tags |= {f"r{k}": (f"r{rng.randrange(60)}", "tag") if rng.random() < 0.8 else ("x", rng.choice(["tree", "blob", "note", None])) for k in range(50)}
    tags |= {"self": ("self", "tag"), "two": ("one", "tag"), "one": ("two", "tag"), "lead": ("two", "tag"), "lost": ("nowhere", "tag")}
    tips = [(t, "tag") for t in tags] + [("c", "commit"), ("z", "tag"), ("q", "odd"), (None, "tag"), ("n", None), ("t3", "tag")]
    df = objects.peeled(spark.createDataFrame(tips, "sha string, kind string"), spark.createDataFrame([(k, *v) for k, v in tags.items()], "sha string, next_sha string, next_kind string"))
    got = sorted(((r.sha, r.kind, (r.peeled_sha, r.peeled_kind, r.hops) if r.reason is None else None, r.reason) for r in df.collect()), key=repr)
    assert got == sorted(((s, k, *plain_peel(s, k, tags)) for s, k in tips), key=repr)
    assert objects.peeled(spark.createDataFrame([("a", "tag")], "sha string, kind string"), df.limit(0).selectExpr("sha", "sha as next_sha", "kind as next_kind")).first().reason == "missing object"


@pytest.mark.parametrize("budget", [0, 1, 57, 10_000])
def test_a_budget_is_spent_in_order(spark, budget):
    rng = random.Random(2)
    rows = [(k, rng.randrange(20), rng.randrange(1, 4)) for k in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = population.within_budget(spark.createDataFrame(rows, "id long, rank long, cost long"), [F.col("rank"), F.col("id")], "cost", budget).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    sums = list(itertools.accumulate(r[2] for r in ordered))
    assert sorted((r.id, r.spent) for r in got) == sorted((r[0], s) for r, s in zip(ordered, sums, strict=True) if s <= budget)


def test_paths_of_a_closure_are_shortest_and_by_the_smallest_parent(spark):
    edges = [("s", "b"), ("s", "a"), ("b", "x"), ("a", "x"), ("x", "s"), ("x", "y"), ("y", "z"), (None, "n"), ("a", None)]
    got = population.closure_with_paths(spark.createDataFrame([("s",)], "node string"), spark.createDataFrame(edges, "src string, dst string"), 3)
    assert {r.node: (r.depth, "".join(r.path)) for r in got.collect()} == {"s": (0, "s"), "a": (1, "sa"), "b": (1, "sb"), "x": (2, "sax"), "y": (3, "saxy")}


def test_answers_are_stored_for_a_while(spark):
    rows = [(0, 304), (10, 200), (20, 304), (60, 304), (61, 304), (62, 500), (63, 200), (113, 200), (164, 200)]
    out = bindings.freshness(spark.createDataFrame([(1, t, s) for t, s in rows], "url long, us long, status int"), ["url"], ["us"], "us", F.col("status"), 50)
    assert [(r.us, r.stored_at, r.mode) for r in out.orderBy("us").collect()] == [(0, None, "first"), (10, None, "first"), (20, 10, "conditional"), (60, 10, "conditional"), (61, 10, "refresh"), (62, 10, "refresh"), (63, 10, "refresh"), (113, 63, "conditional"), (164, 113, "refresh")]


def test_bindings_of_events(spark):
    s = 1_000_000
    rows = [(1, 0, "o0", {"v": 1}), (1, 10 * s, "o1", {"v": 1, "w": 5}), (1, 20 * s, "o2", {"v": 2, "w": 5}), (1, 30 * s, "o3", {"w": 5}), (1, 40 * s, "o4", {"w": 5}), (1, 50 * s, "o5", {"v": 3}), (1, 60 * s, "o6", {"v": 4, "w": 5})]
    df = spark.createDataFrame([(a, b, c, list(d), list(d.values())) for a, b, c, d in rows], "repo long, us long, observation_id string, names array<string>, commits array<long>")
    got = {(r.event, r.ref, r.us // s): r for r in listings.bound_events(df).collect()}
    brief = {k: (tuple(r["from"]), tuple(r.to), r.window_seconds, r.gap_seconds, r.sources) for k, r in got.items()}
    assert brief == {
        ("move", "v", 20): ((1, 0, 10 * s, 2), (2, 20 * s, 20 * s, 1), 10, None, ["o1", "o2"]),
        ("deletion", "v", 30): ((2, 20 * s, 20 * s, 1), (2, 30 * s, 30 * s, 0), 10, None, ["o2", "o3"]),
        ("recreation", "v", 50): ((2, 20 * s, 20 * s, 1), (3, 20 * s, 50 * s, 2), 30, 20, ["o2", "o5"]),
        ("deletion", "w", 50): ((5, 10 * s, 40 * s, 4), (5, 50 * s, 50 * s, 0), 10, None, ["o4", "o5"]),
        ("move", "v", 60): ((3, 20 * s, 50 * s, 2), (4, 60 * s, 60 * s, 1), 10, None, ["o5", "o6"]),
        ("recreation", "w", 60): ((5, 10 * s, 40 * s, 4), (5, 10 * s, 60 * s, 5), 20, 10, ["o4", "o6"]),
    }
