"""The ledger as a sink, streams that don't depend on their batches, sealed days."""

import random
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ledger
from tidemark.sources import schemas, shared
from tidemark.streaming import ledger_sink, observed, replay, sealing

HOUR, DAY = 3_600_000_000, 86_400_000_000


def batch(spark, rows):
    """Ledger rows of (recorded_at, reason), a digest where the reason is empty."""
    kinds = spark.createDataFrame([], schemas.ENTRY).schema
    digest = F.when(F.col("reason") == "", F.from_json(F.lit('{"date": "2026-01-01", "files": []}'), kinds["observation_digest"].dataType))
    own = {"recorded_at": F.col("at"), "event": F.when(F.col("reason") == "", "observation_digest").otherwise("correction"), "reason": F.col("reason"), "corrects_seq": F.lit(0), "format_version": F.lit(1), "observation_digest": digest}
    df = spark.createDataFrame(rows, "at string, reason string")
    return df.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds if f.name not in ("seq", "prev_hash", "entry_hash")])


def at(day, hour=0):
    return f"2026-01-{day:02}T{hour:02}:00:00.000Z"


ORDER = ["recorded_at", "reason"]


def test_a_batch_is_appended_once(spark):
    path, kinds = shared.folder(spark, "sink"), spark.createDataFrame([], schemas.ENTRY).schema
    first, second = batch(spark, [(at(1, 2), "b"), (at(1, 1), "a")]), batch(spark, [(at(2), ""), (at(2, 3), "c")])
    assert ledger_sink.append(first, 0, path, ORDER) == "committed"
    assert ledger_sink.append(first, 0, path, ORDER) == "skipped"
    # a batch that stopped before its commit has left rows, which nobody reads and the next try replaces
    batch(spark, [(at(9), "half")]).write.parquet(f"{path}/rows/batch=1")
    assert ledger_sink.append(second, 1, path, ORDER) == "committed"
    assert ledger_sink.append(batch(spark, []), 2, path, ORDER) == "committed"
    assert ledger_sink.append(second, 1, path, ORDER) == "skipped"
    assert ledger_sink.append(batch(spark, [(at(2, 3), "d")]), 3, path, ORDER) == "committed"
    rows = ledger_sink.committed(spark, path, kinds)
    assert [(r.seq, r.reason) for r in rows.orderBy("seq").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c"), (4, "d")]
    assert ledger.violations(rows).isEmpty()
    assert [(r.batch, r.seq, r.n) for r in ledger_sink.commits(spark, path).orderBy("batch").collect()] == [(0, 1, 2), (1, 3, 2), (2, 3, 0), (3, 4, 1)]


def test_batches_that_the_ledger_refuses(spark):
    path = shared.folder(spark, "sink")
    ledger_sink.append(batch(spark, [(at(2, 5), "a")]), 0, path, ORDER)
    for rows, why in (([(at(2, 4), "b")], "time goes backwards"), ([(None, "b")], "time goes backwards"), ([(at(3, 1), "b"), (at(3, 2), "")], "day without a digest"), ([(at(2, 6), "b"), (at(3), ""), (at(4), "c")], "day without a digest")):
        with pytest.raises(ValueError, match=why):
            ledger_sink.append(batch(spark, rows), 1, path, ORDER)
    assert ledger_sink.commits(spark, path).count() == 1
    assert ledger_sink.append(batch(spark, [(at(3), ""), (at(3, 1), "b")]), 1, path, ORDER) == "committed"


def plain_facts(rows, span):
    """What Observed says, by a loop over all rows of a repository in order."""
    out, state, moves = [], {}, []
    for event, ref, us, outcome, target, resolved, exact in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(ref, {"bound": None, "n": 0, "ok": 0, "pending": None, "since": None, "held": 0})
        if outcome == "ok":
            s["n"], s["ok"] = s["n"] + 1, s["ok"] + 1
            if exact and s["bound"] not in (None, target):
                moves.append((event, ref, us, target))
            s["bound"] = target
            if resolved:
                if s["pending"] == target:
                    out.append(("release", None, ref, us, s["held"], s["since"], None))
                s["pending"] = None
            elif s["pending"] == target:
                s["held"] += 1
            else:
                s["pending"], s["since"], s["held"] = target, us, 1
        elif outcome == "not_modified" and s["ok"]:
            s["n"] += 1
        out.append(("seen", event, ref, us, s["n"], None, None))
    for event, ref, us, target in moves:
        inside = [m for m in moves if m[3] == target and us - span <= m[2] <= us]
        members = sorted({m[1] for m in inside})
        if len(members) >= 3:
            out.append(("batch", event, ref, us, len(members), min(m[2] for m in inside), members))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_facts_of_a_stream_dont_depend_on_its_batches(spark, seed):
    rng = random.Random(seed)
    rows = [(e, f"v1.0.{rng.randrange(5)}", rng.randrange(300) * HOUR // 4 + DAY, rng.choice(["ok", "ok", "ok", "not_modified", "failed"]), rng.randrange(3), rng.random() < 0.7, rng.random() < 0.9) for e in range(150)]
    df = spark.createDataFrame([(1, *r, min(2, (r[2] - DAY + rng.randrange(5) * HOUR) // DAY)) for r in rows] + [(2, -1, "", 40 * DAY, "", 0, False, False, 9)], f"repo long, {observed.ROW}, batch long").withColumn("ts", F.timestamp_micros("us"))
    folder = shared.folder(spark, "facts")
    found = replay.finish(observed.facts(replay.arrive(df, "batch", folder), 6 * HOUR, "12 hours"), folder).collect()
    got = sorted(((r.kind, r.event_id, r.ref, r.us, r.n, r.since, r.members) for r in found), key=repr)
    assert got == plain_facts(rows, 6 * HOUR)


def test_days_without_rows_are_sealed_in_order(spark):
    day = lambda d, h=0: datetime(2026, 3, d, h, tzinfo=UTC)
    rows = [(1, "ok", day(1, 5), 0), (2, "failed", day(1, 6), 0), (1, "ok", day(5, 1), 1), (1, "ok", day(4, 23), 1), (1, "skipped", day(9), 2)]
    folder = shared.folder(spark, "sealed")
    stream = replay.arrive(spark.createDataFrame(rows, "repo long, outcome string, ts timestamp, batch long"), "batch", folder)
    got = [tuple(r) for r in replay.finish(sealing.digests(stream, "ts", "6 hours"), folder).orderBy("day").collect()]
    zeros = (0, 0, 0, 0, 0)
    assert got == [("2026-03-01", 2, 1, 0, 1, 0), ("2026-03-02", *zeros), ("2026-03-03", *zeros), ("2026-03-04", 1, 1, 0, 0, 0), ("2026-03-05", 1, 1, 0, 0, 0), ("2026-03-06", *zeros), ("2026-03-07", *zeros)]


class State:
    """A handle whose list, map and value states are kept here, by name."""

    def __init__(self, kept):
        self.kept = kept

    def getListState(self, name, _):
        return State(self.kept.setdefault(name, []))

    def getMapState(self, name, *_):
        return State(self.kept.setdefault(name, {}))

    def getValueState(self, name, _):
        return State(self.kept.setdefault(name, []))

    def registerTimer(self, at):
        self.kept["timer"] = at

    def getCurrentWatermarkInMs(self):
        return self.kept["watermark"]

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept[0] if self.kept and not isinstance(self.kept[0][0], bytes) else list(self.kept)

    def update(self, value):
        self.kept[:] = [value]

    def put(self, values):
        self.kept[:] = values

    def appendList(self, values):
        self.kept.extend(values)

    def clear(self):
        self.kept.clear()

    def keys(self):
        return iter(self.kept)

    def getValue(self, key):
        return self.kept[key]

    def containsKey(self, key):
        return key in self.kept

    def updateValue(self, key, value):
        self.kept[key] = value

    def removeKey(self, key):
        del self.kept[key]


@pytest.mark.parametrize("kind", [sealing.Held, sealing.Ordered])
def test_rows_wait_packed(kind):
    """Some thousands of rows are one state value, with their nulls, and come back when the watermark passes them."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("us", T.LongType()), T.StructField("day", T.StringType())])
    rows = pd.DataFrame({"event_id": range(5000), "outcome": ["ok", None] * 2500, "us": [DAY + k for k in range(5000)], "day": "1970-01-02"})
    kept = {"watermark": 0}
    held = kind(schema)
    held.init(State(kept))
    assert list(held.handleInputRows(("1970-01-02", 0), iter([rows]), State(kept))) == []
    assert len(kept["rows"]) == 1 and kept["timer"] == DAY // 1000 + (kind is sealing.Ordered)
    kept["watermark"] = DAY // 1000 + 2
    got = pd.concat(held.handleExpiredTimer(("1970-01-02", 0), State(kept), None))
    n = 2000 if kind is sealing.Ordered else 5000
    assert got["event_id"].tolist() == list(range(n)) and got["buffered"].all() and got["outcome"].isna().sum() == n // 2
    assert len(kept["rows"]) == (kind is sealing.Ordered)


def test_many_moves_of_a_span_wait_packed():
    """Thirty thousand moves within a span, of one target after the other."""
    n = 30_000
    rows = pd.DataFrame({"event_id": range(n), "ref": [f"v1.0.{k % 4}" for k in range(n)], "us": range(n), "outcome": "ok", "target": [k // 4 % 2 for k in range(n)], "resolved": True, "exact": True})
    kept = {"watermark": 0}
    o = observed.Observed(DAY)
    o.init(State(kept))
    list(o.handleInputRows((1,), iter([rows]), State(kept)))
    assert len(kept["waiting"]) == 3
    kept["watermark"] = DAY // 1000
    got = pd.concat(o.handleExpiredTimer((1,), State(kept), None))
    moved = n - 4
    assert (got["kind"] == "seen").sum() == n and (got["kind"] == "batch").sum() == moved - 4
    assert not kept["waiting"]
