"""Best-two-fit packing of token pieces into sequences of at most 2048 tokens.

Bins are filled greedily, longest document first and then the longest that fits, until nothing fits.
Then the bin's smallest document is replaced by the two unpacked ones that fit its gap, widened by
that document, most tightly, if they fit it more tightly than the document itself.

Documents of one length are interchangeable, so the plan is made over the counts by length, at most
2048 of them whatever the table's size: a filled bin is repeated as often as its lengths last, which
is what packing bin after bin would do. Spark numbers the pieces of each length, and each piece finds
its bin and place in the plan by its number. A length is numbered in as many parts as its share of all
pieces asks for, SALTS for the whole table, as one length may hold a third of all rows; a piece's part is
hashed from its row number in the staged pieces, so that equal rows are dealt over the parts too.

Token ids are those that tokenizers gives with ``byte_bpe_50k.json`` and add_special_tokens=False: no
token is added, and the string of the file's special token in a text is that token. They are computed
from the same vocabulary as ranks.

Defined cases: a null or empty text is the single id 0; rows that repeat an id are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import stage
from tidemark.llm.words import map_batches, utf8

MOST, SALTS, END = 2048, 8192, 0
SPECIAL = {"<|endoftext|>": 50256}
_encoders: dict = {}


def encoder(ranks: str | None = None):
    """The tokenizer of a file of ranks, loaded once per process."""
    if ranks not in _encoders:
        import public_tokenizers
        import tiktoken

        lines = (x.split() for x in open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
        _encoders[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens=SPECIAL)
    return _encoders[ranks]


def token_ids(text: str, ranks: str | None = None) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a document, the end id included."""
    return np.append(encoder(ranks).encode_to_numpy(text, allowed_special="all"), END).astype("<u4")


def piece_starts(n: int, most: int = MOST) -> list[int]:
    """Where the pieces of n ids begin: all have the most ids, the first may have fewer."""
    return [0, *range(n % most or most, n, most)]


def pieces(docs: DataFrame, most: int = MOST, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; with their ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            rows: list[list] = [[], [], [], [], [], []]
            for i in range(len(batch)):
                t = token_ids(data[off[i] : off[i + 1]].tobytes().decode(), ranks)
                for k, a in enumerate(starts := piece_starts(len(t), most)):
                    p = t[a : starts[k + 1] if k + 1 < len(starts) else len(t)]
                    for column, x in zip(rows, (i, k, a, len(p), zlib.crc32(p.tobytes()), p if ids else None), strict=True):
                        column.append(x)
            out = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            yield pa.RecordBatch.from_arrays([*out, pa.array(rows[5], pa.list_(pa.int32()))][: 5 + ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


class Stock:
    """Unpacked pieces by length; the longest not over a limit is found by table."""

    def __init__(self, counts: dict[int, int], most: int):
        self.n = np.zeros(most + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v
        self.lengths = np.arange(most + 1)
        self.index()

    def index(self) -> None:
        self.below = np.maximum.accumulate(np.where(self.n > 0, self.lengths, 0))

    def take(self, length: int, n: int = 1) -> None:
        self.n[length] -= n
        if not self.n[length]:
            self.index()

    def give(self, length: int, n: int = 1) -> None:
        self.n[length] += n
        if self.n[length] == n:
            self.index()

    def best_two(self, gap: int) -> tuple[int, int]:
        """The two pieces with the largest sum that fits the gap; (0, 0) if there are none."""
        first = self.lengths[1 : gap][self.n[1:gap] > 0]
        if not len(first):
            return 0, 0
        second = self.below[gap - first]
        alone = (second == first) & (self.n[first] < 2)
        if alone.any():
            second = np.where(alone, self.below[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        k = int(total.argmax())
        return (int(first[k]), int(second[k])) if total[k] else (0, 0)


def plan(counts: dict[int, int], most: int = MOST) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces by length, how many bins), in packing order."""
    stock, out = Stock(counts, most), []
    while stock.below[most]:
        bin_: dict[int, int] = {}
        gap = most
        while gap and (x := int(stock.below[gap])):
            k = min(gap // x, int(stock.n[x]))
            bin_[x] = bin_.get(x, 0) + k
            stock.take(x, k)
            gap -= k * x
        small = min(bin_)
        if gap and sum(bin_.values()) > 1:
            a, b = stock.best_two(gap + small)
            if a + b > small:
                for x in (a, b):
                    bin_[x] = bin_.get(x, 0) + 1
                    stock.take(x)
                bin_[small] -= 1
                stock.give(small)
                bin_ = {x: k for x, k in bin_.items() if k}
        more = min(int(stock.n[x]) // k for x, k in bin_.items())
        if more:
            for x, k in bin_.items():
                stock.take(x, k * more)
        out.append((bin_, 1 + more))
    return out


def lookup(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length and number: which numbers of a length go to which bins, and where in them."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for bin_, n in bins:
        at = 0
        for x in sorted(bin_, reverse=True):
            k = bin_[x]
            rows.append((x, used.get(x, 0), first, k, at))
            used[x] = used.get(x, 0) + k * n
            at += k * x
        first += n
    table = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], np.int64)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "bin": table[:, 2], "times": table[:, 3], "at": table[:, 4]}


def numbered(made: DataFrame, counts: dict[int, int], salts: int = SALTS) -> DataFrame:
    """The pieces (with _row, their number) with _rank, gapless from 0 among those of a length; counts has how many each length has."""
    total = max(sum(counts.values()), 1)
    dealt = made.sparkSession.createDataFrame([(x, 1 + salts * n // total) for x, n in counts.items()], "length long, _salts long")
    made = made.join(F.broadcast(dealt), "length")  # at most 2048 rows
    made = made.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int")).drop("_salts")
    parts = made.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    base = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    parts = F.broadcast(parts.select("length", "_salt", base.alias("_base")))  # at most 2048 + SALTS rows
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    return made.withColumn("_own", own).join(parts, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own")).drop("_own", "_base", "_salt", "_row")


def pack(made: DataFrame, most: int = MOST) -> DataFrame:
    """The pieces with sequence_id and offset."""
    made = stage(made.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in made.groupBy("length").count().collect()}
    table = made.sparkSession.sparkContext.broadcast(lookup(plan(counts, most)))
    rows = numbered(made, counts)
    k = [rows.columns.index(c) for c in ("length", "_rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in k)
            i = np.searchsorted(t["key"], (length << 48) + rank, "right") - 1
            own = rank - t["rank"][i]
            sequence, offset = t["bin"][i] + own // t["times"][i], t["at"][i] + own % t["times"][i] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, run, f"{kinds}, sequence_id long, offset long").drop("_rank")


def op10(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
