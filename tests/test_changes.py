"""Changes against a plain fold, batches, scoring and population rules, files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import refs, times
from tidemark.operators import bindings, classify, ledger, listings, population, score
from tidemark.sources import files, published

MINUTE = 60_000_000


def fold(rows):
    """The changes of listings (repo, us, {ref: commit}), one after the other."""
    live, gone, last, out = {}, {}, {}, []
    for repo, us, now in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = live.get(repo)
        if mine is not None:
            for ref in mine.keys() - now.keys():
                out.append((repo, us, "deletion", ref, mine[ref], mine[ref], None))
                gone[repo, ref] = (mine[ref], us)
            for ref, commit in now.items():
                if ref in mine and mine[ref] != commit:
                    out.append((repo, us, "move", ref, mine[ref], commit, (us - last[repo]) // 1_000_000))
                elif ref not in mine and (repo, ref) in gone:
                    was, since = gone.pop((repo, ref))
                    out.append((repo, us, "recreation", ref, was, commit, (us - since) // 1_000_000))
        live[repo], last[repo] = now, us
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_listing_changes_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(repo, k * 7 * MINUTE + repo, {f"v{r}": rng.randrange(3) for r in range(5) if rng.random() < 0.7}) for repo in range(4) for k in range(25)]
    df = spark.createDataFrame([(a, b, list(c), list(c.values())) for a, b, c in rows], "repo long, us long, names array<string>, commits array<long>")
    got = sorted((tuple(r) for r in listings.changes(df).collect()), key=repr)
    assert got == fold(rows)


def moves(spark, rows):
    return spark.createDataFrame(rows, "repo long, target string, us long, ref string")


def test_batches_of_three_and_their_name(spark):
    rows = [(1, "abcdef0123", k * MINUTE, f"v1.0.{k}") for k in range(76)] + [(1, "other", 0, "v9.9.9"), (2, "abcdef0123", 0, "v1.0.0"), (2, "abcdef0123", 30 * MINUTE, "v1.0.1"), (2, "abcdef0123", 61 * MINUTE, "v1.0.2")]
    out = classify.batches(moves(spark, rows), ["repo", "target"], "us", 30 * MINUTE, "ref")
    out = out.withColumn("batch", classify.batch_id(F.col("target"), F.col("batch_start"))).orderBy("us").collect()
    assert len(out) == 74 and {r.repo for r in out} == {1}
    assert out[0].batch == out[28].batch == "corr-abcdef01-0" and out[29].batch != out[28].batch
    assert len(out[-1].members) == 31  # the far end of the window is in it


def test_batch_at_one_instant_is_whole_for_every_row(spark):
    rows = [(1, "t", 5, f"v1.0.{k}") for k in range(346)]
    out = classify.batches(moves(spark, rows), ["repo", "target"], "us", 30 * MINUTE, "ref")
    assert out.count() == 346 and out.where(F.size("members") == 346).count() == 346


@pytest.mark.parametrize("seed", range(2))
def test_batches_and_latest_equal_plain_loops(spark, seed):
    """Ties, instants below zero, null instants and cells' borders; no frame slides and no row meets each other."""
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.choice("ab"), rng.choice([None, *range(-40, 40)]), f"r{rng.randrange(5)}") for _ in range(120)]
    out = classify.batches(moves(spark, rows), ["repo", "target"], "us", 8, "ref")
    inside = lambda x, y: x[:2] == y[:2] and (x[2] is None if y[2] is None else x[2] is not None and y[2] - 8 <= x[2] <= y[2])
    want = [(*y, sorted({x[3] for x in rows if inside(x, y)}), min((x[2] for x in rows if inside(x, y) and x[2] is not None), default=None)) for y in rows]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((w for w in want if len(w[4]) >= 3), key=repr)
    marks = [(rng.randrange(2), rng.choice("abc"), rng.randrange(-50, 50), k) for k in range(40)]
    seen = spark.createDataFrame([(*r[:3], n) for n, r in enumerate(rows) if r[2] is not None], "repo long, target string, us long, seq long")
    got = classify.latest_by(spark.createDataFrame(marks, "repo long, target string, us long, k long"), seen, ["repo", "target"], "us", "seq")
    own = {m: [n for n, r in enumerate(rows) if r[2] is not None and r[:2] == m[:2] and r[2] <= m[2]] for m in marks}
    assert sorted(tuple(r) for r in got.collect()) == sorted((*m, max(n)) for m, n in own.items() if n)
    for df in (out, got):
        plan = df._jdf.queryExecution().toString()
        assert "Join" not in plan and "specifiedwindowframe(RangeFrame, -" not in plan


def test_gaps_and_containment(spark):
    rows = spark.createDataFrame([(1, 0, "ok"), (1, 100, "backoff"), (1, 100, "ok"), (1, 250, "lag"), (1, 400, "ok"), (1, 500, "backoff")], "repo long, us long, what string")
    kind = F.when(F.col("what") == "backoff", "secondary_limit_backoff").when(F.col("what") == "lag", "scheduler_lag")
    gaps = score.recorded_gaps(rows, ["repo"], "us", kind).select("repo", "kind", "gap_from", "gap_to").withColumn("n", F.lit(0))
    assert sorted(tuple(r)[2:4] for r in gaps.collect()) == [(100, 250), (100, 250), (500, 500)]
    actions = spark.createDataFrame([(k, 1, us) for k, us in enumerate((99, 100, 250, 251, 500, 501))], "id long, repo long, us long")
    got = {r.us: r.gap_from for r in score.first_covering(actions, gaps, ["repo"], "us", 64, "id", ["n"]).collect()}
    assert got == {99: None, 100: 100, 250: 100, 251: None, 500: 500, 501: None}


@pytest.mark.parametrize("values", [[5], [1, 2, 3, 4, 5, 6, 7], [3] * 10 + [9000, 5], list(range(0, 90000, 977))])
def test_percentiles_by_floor_index(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = score.floor_percentiles(df, "v", [50, 95, 100]).first()
    s = sorted(values)
    assert (row.n, row.p50, row.p95, row.p100) == (len(s), *[s[p * (len(s) - 1) // 100] for p in (50, 95, 100)])


def test_no_percentiles_of_nothing(spark):
    assert tuple(score.floor_percentiles(spark.createDataFrame([], "v long"), "v", [50]).first()) == (0, None)


def test_closure_with_a_cycle_and_its_cut(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (1, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    reached = population.closure(seeds, edges, 4)
    assert {r.node: r.depth for r in reached.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert [tuple(r) for r in population.cut_off(reached, edges, 4).select("src", "dst").collect()] == [(4, 5)]


def test_poll_groups_keep_no_path_first(spark):
    df = spark.createDataFrame([("r", "b"), ("r", None), ("r", "a"), ("r", "a"), ("q", None)], "repo string, path string")
    assert {r.repo: r.paths for r in population.poll_groups(df, "repo", "path").collect()} == {"r": [None, "a", "b"], "q": [None]}


def test_slots_before_the_second_minute_are_of_the_hour_before(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2026-03-01 10:01:59.9', timestamp_ntz'2026-03-01 10:02:00', timestamp_ntz'2026-03-01 10:06:59', timestamp_ntz'2026-03-01 00:00:00')) AS t")
    got = [r[0] for r in df.select(F.date_format(F.timestamp_micros(times.cron_slot(F.col("t"))), "dd HH:mm:ss")).collect()]
    assert got == ["01 09:57:00", "01 10:02:00", "01 10:02:00", "28 23:57:00"]


def test_skip_reasons(spark):
    rows = ["scheduler_lag", '"secondary_limit_backoff"', '{"scheduler_lag":{"scheduled":"x"}}', '{"poller_down":{"from":"a","to":"b"}}', '{"poller_down":{"from":"a"}}', "poller_down", None, "else"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, reason string").orderBy("k")
    kinds = [r[0] for r in df.select("k", files.skip_reason(F.col("reason"))["kind"].alias("kind")).orderBy("k").select("kind").collect()]
    assert kinds == ["scheduler_lag", "secondary_limit_backoff", "scheduler_lag", "poller_down", None, None, None, None]


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_published_files_only_grow(spark, tmp_path, split):
    """Bytes decide, whatever lies at the borders of splits; lines may have no end, and files of no bytes count as absent."""
    many = b"".join(b"line %d of \xc3\xa9\xff\r\n\n" % k for k in range(60))
    old = {"a/same": many, "a/longer": many, "a/changed": many, "a/shorter": many, "a/gone": many, "b/open": b"x\ny", "b/open-longer": b"x\ny", "b/empty": b"", "b/filled": b"", "b/lost": b"", "b/ends": b"\n\n"}
    new = {"a/same": many, "a/longer": many + b"more\n", "a/changed": many.replace(b"line 31 ", b"line 32 "), "a/shorter": many[:-1], "b/open": b"x\ny\nz\n", "b/open-longer": b"x\nyz\n", "b/empty": b"", "b/filled": b"z", "b/ends": b"\n\n\n", "c/new": b"1\n"}
    for folder, have in (("old", old), ("new", new)):
        for name, raw in have.items():
            path = tmp_path / folder / f"{name}.jsonl"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(raw)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = {r.path for r in published.not_appended(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()}
        got = {r.path: (r.bytes, r.sha256) for r in published.digests(spark, str(tmp_path / "old")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {f"a/{x}.jsonl" for x in ("changed", "shorter", "gone")} | {"b/open-longer.jsonl"}
    assert got == {f"{k}.jsonl": (len(v), "sha256:" + hashlib.sha256(v).hexdigest()) for k, v in old.items() if v}


def test_files_of_other_bytes_than_digests_name(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"1\n")
    (tmp_path / "b.jsonl").write_bytes(b"2\n")
    right = "sha256:" + hashlib.sha256(b"1\n").hexdigest()
    named = spark.createDataFrame([(5, [("a.jsonl", right), ("b.jsonl", right), ("c.jsonl", right)])], "seq long, files array<struct<path:string,sha256:string>>")
    assert [tuple(r) for r in files.files_of_other_bytes(named, published.digests(spark, str(tmp_path))).collect()] == [(5, "b.jsonl")]


def test_observations_by_day_and_repository(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a/b", "2026-01-02T00:00:00.000Z"), ("2", "c/d", "2026-01-03T00:00:00.000Z")], "observation_id string, repo string, observed_at string")
    for r in rows.collect():
        p = tmp_path / r.observed_at[:10].replace("-", "/")
        p.mkdir(parents=True)
        (p / f"{r.repo.replace('/', '--')}.jsonl").write_text(f'{{"observation_id": "{r.observation_id}", "repo": "{r.repo}"}}\n')
    assert files.observations(spark, str(tmp_path)).count() == 2
    assert files.observations(spark, str(tmp_path), repo="a/b").first().observation_id == "1"
    assert files.observations(spark, str(tmp_path), day_from="2026-01-03").first().observation_id == "2"
    files.write_observations(rows, str(tmp_path / "out"))
    again = files.observations(spark, str(tmp_path / "out"))
    assert {(r.observation_id, r.repo, str(r.obs_date)) for r in again.collect()} == {("1", "a/b", "2026-01-02"), ("2", "c/d", "2026-01-03")}
    assert files.observations(spark, str(tmp_path / "out"), repo="a/b").first().observation_id == "1"
    ok = spark.createDataFrame([("1", "a/b", "2026-01-03", ("ok",)), ("2", "a/b", "2026-01-02", ("ok",)), ("3", "a/b", "2026-01-01", ("failed",)), ("4", "c/d", "2026-01-01", ("ok",))], "observation_id string, repo string, observed_at string, outcome struct<type:string>")
    assert [r.observation_id for r in files.ok_observations(ok, "a/b").collect()] == ["2", "1"]


def test_watched_must_be_slugs(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"repo": "a/b"}\n{"repo": "c/d", "path": "x"}\n')
    assert files.watched(spark, str(tmp_path / "w.jsonl")).count() == 2
    (tmp_path / "w.jsonl").write_text('{"repo": "a/b"}\n{"repo": "c"}\n')
    with pytest.raises(Exception, match="not owner/name: c"):
        files.watched(spark, str(tmp_path / "w.jsonl")).count()


def test_first_event_after_an_action_over_cells(spark):
    rng = random.Random(2)
    actions = [(i, rng.choice("ab"), rng.randint(0, 200)) for i in range(60)] + [(60, "a", 500), (61, None, 1)]
    events = [(rng.choice("abc"), rng.randint(0, 220), n) for n in range(80)] + [("a", 70, 900), ("a", 70, 901)]
    a = spark.createDataFrame(actions, "id long, key string, at long")
    e = spark.createDataFrame(events, "key string, event_at long, n long")
    want = {}
    for i, k, t in actions:
        later = sorted((x, n) for key, x, n in events if key == k and x >= t)
        if later:
            want[i] = later[0]
    for span in (7, 1000):
        got = {r.id: (r.event_at, r.n) for r in score.first_after(a, e, ["key"], "at", "event_at", ["n"], ["n"], span).collect()}
        assert got == want


def test_open_rows_older_than_two_days(spark):
    h = 3_600_000_000
    df = spark.createDataFrame([(1, 0), (2, 52 * h), (3, 53 * h), (4, 101 * h)], "seq long, us long")
    assert [r.seq for r in ledger.backlog(df, "us", 48, F.col("seq") != 1).orderBy("seq").collect()] == [2, 3]


def test_reference_without_tags_prefix(spark):
    df = spark.createDataFrame([("refs/tags/v1",), ("v1",)], "n string")
    assert [r[0] for r in df.select(refs.ref_form(F.col("n"))).collect()] == ["floating_major"] * 2
    assert bindings.absent(df, df.limit(1), ["n"]).count() == 1
