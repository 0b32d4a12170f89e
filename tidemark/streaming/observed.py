"""The stream of full observations: counts of bindings, held facts and batches, with state for each repository.

A row waits in its repository's state until the watermark has passed its instant, so that rows are taken
in the order of their instants whatever batch they came in: the result doesn't depend on the batches.
State of a repository:

* ``waiting``: rows whose instant the watermark hasn't passed, packed by days; a timer at the earliest one takes them, day by day;
* ``refs``: for each reference what it is bound to, how often it was seen, and what is pending of it: the target that
  couldn't be resolved, since when and how often;
* ``moves``: of moves of exact references that may still be part of a batch, each target's instants and the last instant of each
  of its references, so that a move doesn't look through the span's others; those that are older than the span go
  with the target's next move, or with the timer one span after the last.

Rows: ``seen`` for every observation of a reference, with the counts of its binding with and without unchanged
polls (an unchanged poll counts from the first ok one, a failed or skipped one never); ``release`` for the first resolved
row after unresolved ones of the same target, with the instant of the first of these and their number (another target
starts anew); ``batch`` for a move with which at least LEAST different exact references came to one target within
the span, both ends included. Rows of one instant see each other.

Defined cases: a null target or instant is refused; rows later than the watermark are dropped by
Spark; what the watermark never passes stays in the state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.packed import CHUNK, pack, unpack

ROW = "event_id long, ref string, us long, outcome string, target long, resolved boolean, exact boolean"
FACT = "kind string, repo long, event_id long, ref string, us long, target long, n long, ok_only long, since long, members array<string>"
LEAST = 3
DAY = 86_400_000_000
_ROW, _FACT = ([x.split()[0] for x in s.split(", ")] for s in (ROW, FACT))
_KIND = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for x in ROW.split(", ")])
_MOVES = pa.schema([("target", pa.int64()), ("us", pa.int64()), ("ref", pa.string())])


class Observed(StatefulProcessor):
    def __init__(self, span: int, least: int = LEAST):
        self.span, self.least = span, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long, n long", "packed binary")
        self.chunks = handle.getValueState("chunks", "n long")
        self.refs = handle.getMapState("refs", "ref string", "target long, n long, ok_only long, pending long, since long, held long")
        self.moves = handle.getListState("moves", "packed binary")

    def keep(self, tables: list[pa.Table], day: int) -> None:
        n = self.chunks.get()[0] if self.chunks.exists() else 0
        for value in pack(pa.concat_tables(tables)):
            self.waiting.updateValue((day, n), (value,))
            n += 1
        self.chunks.update((n,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pa.Table]] = {}
        least = None
        for frame in rows:
            t = pa.Table.from_pandas(frame[_ROW], _KIND, preserve_index=False)
            if t["us"].null_count or t["target"].null_count:
                raise ValueError("null target or instant")
            days = pc.floor(pc.divide(pc.cast(t["us"], pa.float64()), float(DAY))).cast(pa.int64())
            for day in pc.unique(days).to_pylist():
                own = held.setdefault(day, [])
                own.append(t.filter(pc.equal(days, day)))
                if sum(map(len, own)) >= CHUNK:
                    self.keep(held.pop(day), day)
            first = pc.min(t["us"]).as_py()
            least = first if least is None else min(least, first)
        for day, own in held.items():
            self.keep(own, day)
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        yield from ()

    def due(self, passed: int) -> Iterator[tuple]:
        """The rows that the watermark has passed, in order; a day at a time leaves the state."""
        days: dict[int, list[tuple]] = {}
        for k in list(self.waiting.keys()):
            days.setdefault(k[0], []).append(tuple(k))
        for day in sorted(days):
            if day * DAY >= passed:
                self.handle.registerTimer(day * DAY // 1000 + 1)
                return
            t = pa.concat_tables([unpack(self.waiting.getValue(k)[0]) for k in days[day]])
            now = pc.less(t["us"], passed)
            for k in days[day]:
                self.waiting.removeKey(k)
            later = t.filter(pc.invert(now))
            if later.num_rows:
                self.keep([later], day)
                self.handle.registerTimer(pc.min(later["us"]).as_py() // 1000 + 1)
            t = t.filter(now).sort_by([("us", "ascending"), ("event_id", "ascending")])
            for at in range(0, t.num_rows, CHUNK):
                yield from zip(*(c.to_pylist() for c in t.slice(at, CHUNK).columns), strict=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        moves: dict[int, tuple[deque, dict[str, int]]] = {}
        for (value,) in list(self.moves.get()) if self.moves.exists() else []:
            for target, us, ref in zip(*(c.to_pylist() for c in unpack(value).columns), strict=True):
                instants, last = moves.setdefault(target, (deque(), {}))
                if ref is None:
                    instants.append(us)
                else:
                    last[ref] = us
        known, out, any_due = {}, [], False
        for us, same in groupby(self.due(passed), key=lambda r: r[2]):
            any_due, moved = True, []
            for row in same:
                out += self.observe(key[0], known, row, moved)
            for r in moved:
                instants, last = moves.setdefault(r[4], (deque(), {}))
                if not instants or instants[-1] != us:
                    instants.append(us)
                last[r[1]] = us
            for target in {r[4] for r in moved}:
                self.forget(moves[target], us - self.span)
            for r in moved:
                instants, last = moves[r[4]]
                if len(last) >= self.least:
                    out.append(("batch", key[0], r[0], r[1], us, r[4], len(last), None, instants[0], sorted(last)))
            if len(out) >= CHUNK:
                yield self.frame(out)
                out = []
        for ref, state in known.items():
            self.refs.updateValue((ref,), state)
        rows = []
        for target, own in moves.items():
            self.forget(own, passed - self.span)
            rows += [(target, us, None) for us in own[0]] + [(target, us, ref) for ref, us in own[1].items()]
        if rows:
            self.moves.put([(x,) for x in pack(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MOVES)], schema=_MOVES))])
        else:
            self.moves.clear()
        if any_due and rows:
            self.handle.registerTimer((max(r[1] for r in rows) + self.span) // 1000 + 1)
        yield self.frame(out)

    def forget(self, own: tuple[deque, dict[str, int]], before: int) -> None:
        """Drop a target's instants before one, and the references that moved last before it."""
        instants, last = own
        while instants and instants[0] < before:
            instants.popleft()
        for ref in [x for x, us in last.items() if us < before]:
            del last[ref]

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=_FACT).astype({c: "Int64" for c in ("event_id", "target", "n", "ok_only", "since")})

    def observe(self, repo: int, known: dict, row: tuple, moved: list) -> list[tuple]:
        event_id, ref, us, outcome, target, resolved, exact = row
        if ref not in known:
            known[ref] = tuple(self.refs.getValue((ref,))) if self.refs.containsKey((ref,)) else (None, 0, 0, None, None, 0)
        bound, n, ok_only, pending, since, held = known[ref]
        out = []
        if outcome == "ok":
            n, ok_only = n + 1, ok_only + 1
            if exact and bound is not None and bound != target:
                moved.append(row)
            bound = target
            if not resolved:
                since, held = (since, held + 1) if pending == target else (us, 1)
                pending = target
            else:
                if pending == target:
                    out.append(("release", repo, None, ref, us, target, held, None, since, None))
                pending = since = None
                held = 0
        elif outcome == "not_modified" and ok_only:
            n += 1
        known[ref] = (bound, n, ok_only, pending, since, held)
        return [("seen", repo, event_id, ref, us, None, n, ok_only, None, None), *out]

    def close(self) -> None:
        pass


def facts(rows: DataFrame, span: int, delay: str, at: str = "ts", least: int = LEAST) -> DataFrame:
    """FACT rows of a stream of repo, the columns of ROW and an event time; span in microseconds."""
    return rows.withWatermark(at, delay).groupBy("repo").transformWithStateInPandas(Observed(span, least), outputStructType=FACT, outputMode="Append", timeMode="EventTime")
