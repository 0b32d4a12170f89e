"""Ledger rows of events, batches and failed polls."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entries, ledger
from tidemark.sources import schemas

AT = "2026-10-01T00:00:0{}.000Z"


def polls(spark):
    rows = [("1", "a/b", 0, "failed", 301, "x/y"), ("2", "a/b", 1, "failed", 302, None), ("3", "a/b", 2, "failed", 404, None), ("4", "a/b", 3, "failed", 500, None), ("5", "a/b", 4, "ok", 200, None), ("6", "a/b", 5, "skipped", None, None)]
    return spark.createDataFrame([(i, r, AT.format(t), (o, s), loc) for i, r, t, o, s, loc in rows], "observation_id string, repo string, observed_at string, outcome struct<type:string,http_status:int>, redirect_location string")


def test_failed_polls_make_valid_rows(spark):
    made = entries.entries(entries.repository_events(polls(spark)))
    assert made.columns == [c for c in spark.createDataFrame([], schemas.ENTRY).columns if c not in entries.LINKS]
    got = sorted((r.recorded_at, r.event, r.http_status, r.redirect_location) for r in made.collect())
    assert got == [(AT.format(0), "repo_redirected", 301, "x/y"), (AT.format(1), "repo_redirected", 302, ""), (AT.format(2), "repo_unavailable", 404, None)]
    linked = ledger.link(made, ["recorded_at"])
    assert ledger.violations(linked).isEmpty() and ledger.verdict(linked).first().entries == 3


def test_batches_name_the_rows_of_their_members(spark):
    rows = [("a/b", "v1", "move", 0, 3), ("a/b", "v1", "move", 1, 7), ("a/b", "v2", "deletion", 2, 5), ("c/d", "v1", "move", 1, 9), ("a/b", "v1", "correction", 1, 11), ("a/b", "v1", "move", 5, 99)]
    rows = spark.createDataFrame([(a, b, c, AT.format(t), n) for a, b, c, t, n in rows], "repo string, ref string, event string, recorded_at string, seq long")
    batch = [("a/b", AT.format(1), "corr-1", ["v1", "v2"], True, None), ("a/b", AT.format(2), "corr-1", ["v1", "v2"], True, None), ("a/b", AT.format(0), "corr-0", ["v1"], True, None)]
    schema = "repo string, recorded_at string, batch_id string, refs array<string>, all_to_same_target boolean, note string"
    got = entries.correlations(spark.createDataFrame(batch, schema), rows).collect()
    # rows of the ledger after a batch are no members of it
    assert sorted((r.event, r.recorded_at, r.correlation.member_seqs) for r in got) == [("correlation", AT.format(0), [3]), ("correlation", AT.format(2), [5, 7])]
    for refs, at in ((["v1", "v9"], 3), (["v2"], 1)):
        with pytest.raises(Exception, match="no row of v"):
            entries.correlations(spark.createDataFrame([("a/b", AT.format(at), "corr-2", refs, True, None)], schema), rows).collect()


def test_recovery_takes_ok_polls_that_no_binding_row_names(spark):
    polls_ = polls(spark).unionByName(spark.createDataFrame([(i, "a/b", AT.format(t), ("ok", 200), None) for i, t in (("7", 1), ("8", 6), ("9", 7))], "observation_id string, repo string, observed_at string, outcome struct<type:string,http_status:int>, redirect_location string"))
    led = spark.createDataFrame([("move", AT.format(1), ["1", "8"]), ("correlation", AT.format(0), ["5"]), ("recreation", AT.format(0), None)], "event string, recorded_at string, source_observations array<string>")
    assert sorted(r.observation_id for r in entries.not_sourced(polls_, led).collect()) == ["5", "9"]
    assert entries.not_sourced(polls_, led.limit(0)).count() == 0


def test_digests_list_files_once_and_new_notes(spark):
    days = spark.createDataFrame([("2026-10-01", 1, 2, 0, 0, 1), ("2026-10-02", 0, 0, 0, 0, 0)], "date string, repos_polled long, ok long, not_modified long, failed long, skipped long")
    files = spark.createDataFrame([("2026-10-01", "b", "sha256:1"), ("2026-10-01", "B", "sha256:2"), ("2026-10-01", "a", "sha256:3")], "date string, path string, sha256 string")
    notes = spark.createDataFrame([("2026-10-01", "y"), ("2026-10-01", "x"), ("2026-10-02", "x"), ("2026-10-02", "")], "date string, note string")
    made = entries.digests(days, files, notes)
    got = {r.recorded_at: r.observation_digest for r in made.collect()}
    one, two = got["2026-10-02T00:00:00.000Z"], got["2026-10-03T00:00:00.000Z"]
    assert [f.path for f in one.files] == ["B", "a", "b"] and one.note == "x; y" and two.files == [] and two.note is None
    assert ledger.violations(ledger.link(made, ["recorded_at"])).isEmpty()
    with pytest.raises(Exception, match="a path twice"):
        entries.digests(days, files.unionByName(files), notes).collect()


def test_events_of_one_observation_are_in_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("move", "repo_redirected", "recreation", "else", "deletion", "repo_unavailable")], "event string")
    assert [r.event for r in rows.orderBy(entries.event_rank(F.col("event"))).collect()] == ["repo_unavailable", "repo_redirected", "deletion", "recreation", "move", "else"]
