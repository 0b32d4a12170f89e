"""Days that are sealed in order, and rows that wait for it.

The digest of a day is the first row of the next day, so no row of a day may be written before all days
before it are sealed. A day is sealed when the watermark passes its end. Rows wait, in parts of their day, until the
watermark passes their day's beginning, which is no longer than the watermark's delay; then they, and all
later rows of the day, go through. Digests come from a window of a day; a clock with one row a day follows,
which seals days without any row by timers, in order.

Defined cases: rows later than the watermark are dropped by Spark; the days that the watermark never passes, and the rows
that wait for them, stay in the state; no rows give no digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming import windows
from tidemark.streaming.packed import pack, unpack

DIGEST = "day string, repos_polled long, ok long, not_modified long, failed long, skipped long"
COUNTS = ("repos_polled", "ok", "not_modified", "failed", "skipped")
DAY_MS = 86_400_000
_EPOCH = date(1970, 1, 1).toordinal()


def day_ms(day: str) -> int:
    """The beginning of a day (YYYY-MM-DD, UTC) in milliseconds."""
    return (date.fromisoformat(day).toordinal() - _EPOCH) * DAY_MS


def day_of(ms: int) -> str:
    return date.fromordinal(ms // DAY_MS + _EPOCH).isoformat()


class Held(StatefulProcessor):
    """Rows of one part of a day, until the watermark passes the day's beginning."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.kind = to_arrow_schema(schema)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")

    def keep(self, rows: pa.Table) -> None:
        self.rows.appendList([(x,) for x in pack(rows)])

    def kept(self) -> Iterator[pa.Table]:
        return (unpack(x) for (x,) in self.rows.get()) if self.rows.exists() else iter(())

    def table(self, rows: pd.DataFrame) -> pa.Table:
        return pa.Table.from_pandas(rows[self.schema.names], self.kind, preserve_index=False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begins = day_ms(key[0])
        for t in rows:
            if timerValues.getCurrentWatermarkInMs() >= begins:
                yield t[self.schema.names].assign(buffered=False)
            else:
                self.keep(self.table(t))
                self.handle.registerTimer(begins)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for t in self.kept():
            yield frame(t)
        self.rows.clear()

    def close(self) -> None:
        pass


def frame(rows: pa.Table) -> pd.DataFrame:
    """Rows that waited; numbers that may be null stay whole numbers."""
    return rows.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get).assign(buffered=True)


class Ordered(Held):
    """Rows of one part of a day, until the watermark passes their own instant (microseconds, in us)."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for t in rows:
            self.keep(self.table(t))
            self.handle.registerTimer(int(t["us"].min()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, waiting = timerValues.getCurrentWatermarkInMs() * 1000, []
        for t in self.kept():
            due = pc.less(t["us"], passed)
            if pc.any(due).as_py():
                yield frame(t.filter(due))
            waiting.append(t.filter(pc.invert(due)))
        self.rows.clear()
        if (later := pa.concat_tables(waiting) if waiting else None) is not None and later.num_rows:
            self.keep(later)
            self.handle.registerTimer(pc.min(later["us"]).as_py() // 1000 + 1)


class Clock(StatefulProcessor):
    """Days in order: those with a row as they close, those without by a timer at their end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sealed = handle.getValueState("sealed", "day string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("day").itertuples():
            out += self.empty(day_ms(row.day))
            out.append((row.day, *(int(getattr(row, c)) for c in COUNTS)))
            self.sealed.update((row.day,))
        self.wait()
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        out = self.empty(passed - passed % DAY_MS)
        self.wait()
        yield self.frame(out)

    def empty(self, before: int) -> list[tuple]:
        """Digests of the days after the last sealed one that end by an instant, which is a day's beginning."""
        if not self.sealed.exists():
            return []
        days = [day_of(ms) for ms in range(day_ms(self.sealed.get()[0]) + DAY_MS, before, DAY_MS)]
        if days:
            self.sealed.update((days[-1],))
        return [(d, 0, 0, 0, 0, 0) for d in days]

    def wait(self) -> None:
        """A timer at the end of the day after the last sealed one."""
        if self.sealed.exists():
            self.handle.registerTimer(day_ms(self.sealed.get()[0]) + 2 * DAY_MS)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["day", *COUNTS])

    def close(self) -> None:
        pass


def held(rows: DataFrame, at: str, delay: str, part: str, parts: int = 64, ordered: bool = False) -> DataFrame:
    """The rows (columns of numbers and text, and the event time, which isn't kept) as they may be written, with day and buffered.

    Where ordered, each waits for its own instant (us), so that no batch has an earlier one than the batch before.
    """
    keep = [c for c in rows.columns if c != at]
    day = F.date_format(at, "yyyy-MM-dd")
    keyed = rows.withWatermark(at, delay).withColumns({"day": day, "_part": F.pmod(F.xxhash64(part), F.lit(parts))})
    own = T.StructType([rows.schema[c] for c in keep] + [T.StructField("day", T.StringType())])
    out = T.StructType([*own.fields, T.StructField("buffered", T.BooleanType())])
    return keyed.groupBy("day", "_part").transformWithStateInPandas((Ordered if ordered else Held)(own), outputStructType=out, outputMode="Append", timeMode="EventTime")


def digests(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """DIGEST rows of a stream of repo, outcome and an event time, each after its day's end, all days in order."""
    closed = windows.counts(rows, at, delay).select(F.window_time("window").alias("_at"), F.date_format("window.start", "yyyy-MM-dd").alias("day"), *COUNTS, F.lit(0).alias("ledger"))
    return closed.groupBy("ledger").transformWithStateInPandas(Clock(), outputStructType=DIGEST, outputMode="Append", timeMode="EventTime")
