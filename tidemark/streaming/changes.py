"""The listing changes of ``operators.listings`` as a stream, with state for each repository.

State: what every live reference is bound to, tombstones of deleted ones (kept for good, so that a
reference that comes back years later is still a recreation), and the last listing's instant. A
repository's listings must arrive in the order of their instants over the micro-batches; within one
they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.listings import EVENT

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = [x.split()[0] for x in EVENT.split(", ")]


class Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "ref string", "commit long")
        self.gone = handle.getMapState("gone", "ref string", "commit long, us long")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("us").itertuples():
            out += self.listing(key[0], int(row.us), dict(zip(row.names, (int(c) for c in row.commits), strict=True)))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"seconds": "Int64"})

    def listing(self, repo, us: int, now: dict[str, int]) -> list[tuple]:
        out = []
        last = self.last.get()[0] if self.last.exists() else None
        before = {k[0]: v[0] for k, v in self.live.iterator()}
        for ref, commit in before.items():
            if ref not in now:
                out.append((repo, us, "deletion", ref, commit, commit, None))
                self.gone.updateValue((ref,), (commit, us))
                self.live.removeKey((ref,))
        for ref, commit in now.items():
            if ref in before:
                if before[ref] != commit:
                    out.append((repo, us, "move", ref, before[ref], commit, (us - last) // 1_000_000))
            elif self.gone.containsKey((ref,)):
                was, since = self.gone.getValue((ref,))
                out.append((repo, us, "recreation", ref, was, commit, (us - since) // 1_000_000))
                self.gone.removeKey((ref,))
            if before.get(ref) != commit:
                self.live.updateValue((ref,), (commit,))
        self.last.update((us,))
        return out

    def close(self) -> None:
        pass


def changes(listings: DataFrame) -> DataFrame:
    """EVENT rows of a stream of repo, us, names, commits; append mode."""
    return listings.groupBy("repo").transformWithStateInPandas(Changes(), outputStructType=EVENT, outputMode="Append", timeMode="None")


def replay(listings: DataFrame, folder: str) -> DataFrame:
    """Run a stream of listings to its end and read what it wrote; folder is shared and new."""
    spark = listings.sparkSession
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        q = changes(listings).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/events")
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return spark.read.schema(EVENT).parquet(f"{folder}/events")
