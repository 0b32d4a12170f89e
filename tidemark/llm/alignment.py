"""Alignment of two tokenizers' tokens over the bytes of each text, by joins.

A is a byte-level BPE over the text with a space before it, B a piece BPE that adds that space itself. Both
give tokens that are runs of the same bytes. Where an A and a B token end at one byte, a group ends; the tokens
of a group are linked where their bytes overlap. The tokens are exploded with their places, their ends are
windowed running lengths, the cuts an equality join on ends, the groups a running count of cuts, and
the links the overlaps within groups (of a long group by a range join in cells of bytes, so that it doesn't join all with all).

Stretches instead of documents. In both tokenizers a token ends before a single space, or a single line's end,
between two other characters: A's pattern has white space only before what it belongs to, and no piece of B has its
space sign after another character, or a line's end at all (``separable`` looks). So a text is a row of stretches,
each such a sign and what follows, that are tokenized and aligned alike wherever they occur. Documents are read in blocks of some
megabytes; a block has each different stretch once and each document as numbers of stretches. The joins run
over the different stretches of the corpus, with their counts and places (at most one a block), and their results come back to the blocks, where
each document adds them up and hashes its groups in order. A text without such spaces is one stretch.
Steps that only written ones have read are removed, and so are their shuffles, so that the disk holds one step's at a time.

A pair's count over the corpus adds up its links in every stretch times the stretch's occurrences in valid texts.

Defined cases: a null or empty text has no tokens, nor has one whose joined tokens of A or B aren't the bytes of a
space and the text (one with the sign U+2581, which B takes for a space): zeros and an empty digest, and nothing
of it counts corpus-wide. Rows that repeat an id or text are rows of their own and count each. The special tokens'
strings are plain text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import folder
from tidemark.llm.words import give_back, map_batches

BLOCK, CELL, PAIRS, HOT, TAKEN, MARK = 32 << 20, 32, 1024, 1 << 18, 1 << 16, "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: What goes back to the blocks beside a stretch's groups, which say the other counts.
SENT = ("n_a", "n_best", "count_sum")
#: The signs of a digest's text beside decimal digits, ``packed_text`` as hexadecimal ones; an odd number of signs ends in one more.
SIGNS, SPARE = bytes.maketrans(b"abc", b",|;"), "d"
_single = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
_other = re.compile(r"\A\s|\s\s|\s\Z|\0")
_pairs: dict = {}


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``storage.stage`` with the denser codec, as the steps here are about as large as the texts."""
    path = path or folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove the files of a step that only written steps have read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def packed(ks: np.ndarray) -> bytes:
    """Numbers of stretches as compressed bytes, the lowest ones of all first; other codecs see only four bytes each."""
    return zlib.compress(np.ascontiguousarray(ks.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(ks: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(ks), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def packed_text(text: Column) -> Column:
    """Half as many bytes for a text of decimal digits and a, b and c for the signs between them."""
    return F.unhex(F.concat(text, F.when(F.length(text) % 2 == 1, F.lit(SPARE)).otherwise(F.lit(""))))


def digest(parts: Iterable[str]) -> str:
    """SHA-256 of texts, each the hexadecimal digits of a ``packed_text``, with a semicolon between every two."""
    found = hashlib.sha256()
    for k, part in enumerate(parts):
        found.update(b";" * (k > 0) + part.encode().translate(SIGNS, SPARE.encode()))
    return found.hexdigest()


class Groups:
    """The groups of a block's stretches, each a ``packed_text`` that ends in one more c, in one buffer."""

    def __init__(self, column: pa.ChunkedArray):
        self.rows = pa.concat_arrays([x.cast(pa.large_binary()) for x in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
        self.off, self.data = parted(self.rows)

    def signs(self, sign: int) -> np.ndarray:
        """How often each stretch has a hexadecimal digit."""
        table, found = bytes((x >> 4 == sign) + (x & 15 == sign) for x in range(256)), np.zeros(len(self.rows), np.int32)
        for a in range(0, len(found), TAKEN):
            off = self.off[a : a + TAKEN + 1]
            some = self.data[off[0] : off[-1]].tobytes().translate(table)
            found[a : a + TAKEN] = np.add.reduceat(np.frombuffer(some, np.uint8), off[:-1] - off[0], dtype=np.int32)
        return found

    def text(self, at: np.ndarray) -> str:
        """The hexadecimal digits of some stretches' groups in order, with a c between every two stretches."""
        return parted(self.rows.take(pa.array(at)))[1].tobytes().hex().rstrip(SPARE)[:-1]


def parted(rows: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row begins (one more entry at the end) in the bytes of all."""
    off = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return off - off[0], data


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, ranks: str | None, pieces: str | None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        lines = (x.split() for x in open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
        merged = {base64.b64decode(a): int(b) for a, b in lines}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})
        self.a_bytes = {i: x for x, i in merged.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        a_sizes = np.zeros(max(self.a_bytes) + 1, np.int16)
        for i, x in self.a_bytes.items():
            a_sizes[i] = len(x)
        self.sizes = a_sizes, np.array([len(x) for x in self.b_bytes], np.int16)
        #: whether no piece holds the space sign after another character, or a line's end, so that texts fall into stretches
        self.separable = not any(MARK in x.lstrip(MARK) or "\n" in x for x in names)

        every = (chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and chr(k) != MARK)
        tried = itertools.chain([" a", "a ", "a  b"], iter(lambda: "".join(itertools.islice(every, 4096)), ""))
        #: whether B gives back all characters and runs of spaces, so that only texts with its space sign have other bytes
        self.faithful = all(self.same("\0" + x, self.b.encode(x)) for x in tried)

    def encode_b(self, stretches: list[str]) -> list[list[int]]:
        """Ids of B; the space that it adds before a line's end is left out again."""
        found = self.b.encode([x[1:] if x[0] == "\0" else x for x in stretches], num_threads=1)
        return [ids[1:] if x[0] == "\n" else ids for x, ids in zip(stretches, found, strict=True)]

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each stretch."""
        return [self.a.encode_ordinary(spaced(x)) for x in stretches], self.encode_b(stretches)

    def same(self, stretch: str, b: list[int]) -> bool:
        """Whether B's tokens are the stretch's bytes; A's always are."""
        return b"".join(map(self.b_bytes.__getitem__, b)) == spaced(stretch).encode()

    def whole(self, stretches: list[str]) -> np.ndarray:
        """For each stretch whether B's tokens are its bytes."""
        if self.faithful:
            return np.array([MARK not in x for x in stretches], bool)
        return np.array([self.same(x, b) for x, b in zip(stretches, self.encode_b(stretches), strict=True)], bool)

    def cut(self, text: str) -> list[str]:
        """The stretches of a space and a text, named as ``spaced`` says."""
        if not self.separable:
            return [escaped(text)]
        if not _other.search(text):  # all white space is single and inside
            return text.replace("\n", " \n").split(" ")
        first, *rest = _single.split(text)
        return [escaped(first), *("\0" + x if x[0] == "\0" else x for x in rest)]


def spaced(stretch: str) -> str:
    """The characters of a stretch by its name: those of a line's end and what follows are themselves, others follow a space.

    A name that would begin otherwise with a line's end or a zero has one more zero before it.
    """
    return stretch if stretch[0] == "\n" else " " + stretch[stretch[0] == "\0" :]


def escaped(text: str) -> str:
    return "\0" + text if text[0] in "\n\0" else text


def pair(ranks: str | None = None, pieces: str | None = None) -> Pair:
    """The tokenizers of two files, loaded once per process."""
    if (ranks, pieces) not in _pairs:
        _pairs[ranks, pieces] = Pair(ranks, pieces)
    return _pairs[ranks, pieces]


def forget() -> None:
    """Free this process's tokenizers, for work that tokenizes nothing."""
    _pairs.clear()


class Seen:
    """The different stretches of a block so far: their numbers, whether B gives their bytes, and their occurrences in valid texts.

    Texts are cut and numbered one by one, so that a block holds its different stretches but none of its texts.
    """

    def __init__(self, both: Pair):
        self.both, self.good, self.count = both, np.zeros(0, bool), np.zeros(0, np.int64)
        self.numbers: dict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def numbers_of(self, text: str | None) -> np.ndarray | None:
        """The numbers of a text's stretches, counted; none if it has no tokens."""
        if not text:
            return None
        numbers, known = self.numbers, len(self.numbers)
        ks = np.fromiter(map(numbers.__getitem__, self.both.cut(text)), np.int32)
        if len(numbers) > len(self.good):
            for x in (self.good, self.count):
                x.resize(len(numbers) * 5 // 4, refcheck=False)
        if len(numbers) > known:
            self.good[known : len(numbers)] = self.both.whole(list(itertools.islice(reversed(numbers), len(numbers) - known))[::-1])
        if not self.good[ks].all():
            return None
        np.add.at(self.count, ks, 1)
        return ks


def blocks(docs: DataFrame, ranks: str | None = None, pieces: str | None = None, size: int = BLOCK) -> DataFrame:
    """block with either stretch, k and n (number in the block, occurrences in valid texts), or doc_id and ks.

    ks has a valid document's stretches in order, ``packed``; it is null without tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, room, seen = TaskContext.get().partitionId() << 32, 0, Seen(pair(ranks, pieces))
        for batch in batches:
            if room >= size:
                yield from stretches(number, seen)
                number, room, seen = number + 1, 0, Seen(seen.both)
            ks = [None if r is None else packed(r) for r in map(seen.numbers_of, batch.column(1).to_pylist())]
            yield out(number, len(batch), doc_id=batch.column(0), ks=pa.array(ks, pa.binary()))
            room += batch.column(1).nbytes
        yield from stretches(number, seen)

    def stretches(number: int, seen: Seen) -> Iterator[pa.RecordBatch]:
        a = 0
        for part in itertools.batched(seen.numbers, 20_000):
            b = a + len(part)
            yield out(number, len(part), stretch=pa.array(part, pa.string()), k=pa.array(np.arange(a, b, dtype=np.int32)), n=pa.array(seen.count[a:b]))
            a = b

    kinds = {"block": pa.int64(), "doc_id": None, "ks": pa.binary(), "stretch": pa.string(), "k": pa.int32(), "n": pa.int64()}
    own = {"doc_id": None}

    def out(number: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        if "doc_id" in columns:
            own["doc_id"] = columns["doc_id"].type
        full = {"block": pa.array(np.full(rows, number, np.int64))} | columns
        return pa.RecordBatch.from_arrays([full[c] if c in full else pa.nulls(rows, t or own["doc_id"]) for c, t in kinds.items()], list(kinds))

    return map_batches(docs.select("doc_id", "text"), run, f"block long, doc_id {kind}, ks binary, stretch string, k int, n long")


def tokenized(stretches: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """The rows of stretch and n with the number n_a of A's tokens, and ids and sizes in bytes of A's tokens and then B's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(ranks, pieces)
        for batch in batches:
            n, flat = [], []
            for rows in both.encode(batch.column("stretch").to_pylist()):
                n.append(np.fromiter(map(len, rows), np.int64, len(rows)))
                flat.append(np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(n[-1].sum())))
            before = [np.cumsum(x) - x for x in n]
            place = [np.arange(len(flat[0])) + np.repeat(before[1], n[0]), np.arange(len(flat[1])) + np.repeat(before[0] + n[0], n[1])]
            ids, sizes = np.empty(len(flat[0]) + len(flat[1]), np.int32), np.empty(len(flat[0]) + len(flat[1]), np.int16)
            for side in (0, 1):
                ids[place[side]], sizes[place[side]] = flat[side], both.sizes[side][flat[side]]
            off = np.append(0, np.cumsum(n[0] + n[1])).astype(np.int32)
            total = [np.add.reduceat(np.append(both.sizes[side][flat[side]].astype(np.int64), 0), before_) for side, before_ in enumerate(before)] if len(n[0]) else [np.zeros(0), np.zeros(0)]
            if (total[0] != total[1]).any():
                raise ValueError("tokens of other bytes than the text's")
            lists = (pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (ids, sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n[0].astype(np.int32)), *lists], [*batch.schema.names, "n_a", "ids", "sizes"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in stretches.schema)
    return map_batches(stretches, run, kinds + "n_a int, ids array<int>, sizes array<smallint>")


def placed(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """uid, side (0 for A, 1 for B), pos, id, start and end of the tokens, and what is kept, on a text's first token."""
    once = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in keep]
    rows = texts.select("uid", "n_a", *keep, F.posexplode(F.arrays_zip("ids", "sizes")).alias("pos", "_t"))
    return ended(rows.select("uid", (F.col("pos") >= F.col("n_a")).cast("int").alias("side"), "pos", F.col("_t.ids").alias("id"), F.col("_t.sizes").alias("size"), *once))


def ended(rows: DataFrame) -> DataFrame:
    """start and end of tokens of uid, side, pos and size."""
    w = Window.partitionBy("uid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum("size").over(w)).withColumn("start", F.col("end") - F.col("size")).drop("size")


def cuts(texts: DataFrame) -> DataFrame:
    """uid and end wherever tokens of both sides end."""
    rows = ended(texts.select("uid", "n_a", F.posexplode("sizes").alias("pos", "size")).select("uid", (F.col("pos") >= F.col("n_a")).cast("int").alias("side"), "pos", "size"))
    a, b = (rows.where(F.col("side") == side).select("uid", "end") for side in (0, 1))
    return a.join(b, ["uid", "end"])


def grouped(tokens: DataFrame, cuts: DataFrame) -> DataFrame:
    """The tokens with grp, the number of cuts before their end."""
    w = Window.partitionBy("uid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = tokens.join(cuts.withColumn("_cut", F.lit(1)), ["uid", "end"], "left")
    return marked.withColumn("grp", F.coalesce(F.sum("_cut").over(w), F.lit(0))).drop("_cut")


def of_groups(tokens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """uid, grp, arrays a and b of the group's tokens (id, start, end) in order, and what is kept; tokens have grp."""
    own = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "id", "start", "end")))), lambda x: F.struct(x["id"].alias("id"), x["start"].alias("start"), x["end"].alias("end")))
    return tokens.groupBy("uid", "grp").agg(own(0).alias("a"), own(1).alias("b"), *[F.max(c).alias(c) for c in keep])


def links_within(a: Column, b: Column) -> Column:
    """a and b of every two tokens of two lists that overlap."""
    meet = lambda x, y: F.greatest(x["start"], y["start"]) < F.least(x["end"], y["end"])
    return F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: meet(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))


def links_by_cells(groups: DataFrame, cell: int = CELL) -> DataFrame:
    """stretch, n, a and b of every two tokens of a group that overlap, by a range join.

    Tokens are listed in the cells of bytes that they touch; a link is found in the cell where its bytes begin.
    """

    def cells(side: str) -> DataFrame:
        t = groups.select("stretch", "n", "grp", F.explode(side).alias("_t"))
        return t.select("stretch", "n", "grp", F.col("_t").alias(side), F.explode(F.sequence(F.floor(F.col("_t.start") / cell), F.floor((F.col("_t.end") - 1) / cell))).alias("_cell"))

    met = cells("a").join(cells("b").drop("n"), ["stretch", "grp", "_cell"])
    first = F.greatest("a.start", "b.start")
    return met.where((first < F.least("a.end", "b.end")) & (F.floor(first / cell) == F.col("_cell"))).select("stretch", "n", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles that written steps no longer need.

    It does so when the driver's JVM finds them to be garbage, which Spark itself only asks for every half hour
    (spark.cleaner.periodicGC.interval): until then the files of all steps would lie on the disks together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold while it lasts; names without ``spark.sql.`` and with __ for their points."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def aligned(texts: DataFrame, most: int = PAIRS, path: str | None = None) -> DataFrame:
    """Of texts (uid, n, n_a, ids, sizes): stretch (the uid), n, n_a, n_b, n_groups, groups (as ``Groups`` has them), links (array of a and b), and rest.

    The texts are dealt out by uid, and all joins and windows are within a uid: no other exchange. rest has the
    groups of more than ``most`` possible pairs, which aren't in links, for ``links_by_cells``.
    """
    keep = ("n",)
    ends = cuts(texts.select("uid", "n_a", "sizes").repartition("uid"))
    tokens = placed(texts.select("uid", "n_a", *keep, "ids", "sizes").repartition("uid"), keep)
    ids = lambda side: F.array_join(F.transform(side, lambda x: x["id"].cast("string")), "a")
    large = F.size("a").cast("long") * F.size("b") > most
    groups = of_groups(grouped(tokens, ends), keep)
    groups = groups.select("uid", "grp", *keep, F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.concat(ids("a"), F.lit("b"), ids("b")).alias("g"), F.when(~large, links_within(F.col("a"), F.col("b"))).alias("links"), *[F.when(large, F.col(x)).alias(x) for x in ("a", "b")])
    none = "array<struct<grp:long,a:array<struct<id:int,start:long,end:long>>,b:array<struct<id:int,start:long,end:long>>>>"
    each = F.array_sort(F.collect_list(F.struct("grp", "g")))
    rest = F.collect_list(F.when(F.col("a").isNotNull(), F.struct("grp", "a", "b"))).cast(none)
    sums = [F.max("n").alias("n"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups")]
    whole = groups.groupBy("uid").agg(*sums, packed_text(F.concat(F.array_join(F.transform(each, lambda x: x["g"]), "c"), F.lit("c"))).alias("groups"), F.flatten(F.collect_list("links")).alias("links"), rest.alias("rest"))
    # rows that are dealt out by some of a join's keys aren't dealt out anew by all of them
    with settings(texts.sparkSession, requireAllClusterKeysForCoPartition="false"):
        return stage(whole.withColumnRenamed("uid", "stretch"), "groups", path)


def links_of(found: DataFrame) -> DataFrame:
    """stretch, n, a, b of every link of what was aligned."""
    own = found.select("stretch", "n", F.explode("links").alias("_l")).select("stretch", "n", "_l.a", "_l.b")
    return own.unionByName(links_by_cells(found.select("stretch", "n", F.explode("rest").alias("_g")).select("stretch", "n", "_g.grp", "_g.a", "_g.b")))


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count, best (1 if it is the highest of its b) from links with n, the times that each is there."""
    counts = stage(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("_top"))
    return stage(counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("_top")).cast("long").alias("best")), "best-pairs")


def link_sums(links: DataFrame, counted: DataFrame, hot: int = HOT) -> DataFrame:
    """stretch, n_best, count_sum of links of stretch, a, b.

    Pairs with at least one in ``hot`` of all occurrences are at most so many and are broadcast; the others are joined by a shuffle.
    """
    total = counted.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * hot >= total
    frequent = counted.where(often)
    known = links.join(F.broadcast(frequent), ["a", "b"])
    rest = links.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti").join(counted.where(~often), ["a", "b"])
    return known.unionByName(rest).groupBy("stretch").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


def op12(docs: DataFrame, ranks: str | None = None, pieces: str | None = None, block: int = BLOCK, most: int = PAIRS, hot: int = HOT) -> DataFrame:
    spark = docs.sparkSession
    at = {name: folder(spark, name) for name in ("blocks", "stretches", "groups")}
    cut = stage(blocks(docs, ranks, pieces, block), "blocks", at["blocks"])
    numbers = stage(cut.where("stretch is null").select("block", "doc_id", "ks"), "numbers")
    every = cut.where("stretch is not null and n > 0")
    # a block has each of its stretches once, so a task's rows of a stretch are few and adding them up before the exchange would spare nothing
    different = every.repartition("stretch").groupBy("stretch").agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "k")).alias("places"))
    texts = stage(tokenized(different, ranks, pieces).drop("stretch").withColumn("uid", F.monotonically_increasing_id()), "stretches", at["stretches"])
    remove(spark, at["blocks"])
    let_go(spark)
    found = aligned(texts, most, at["groups"])
    let_go(spark)
    counted = pair_counts(links_of(found))
    let_go(spark)
    sums = link_sums(links_of(found).drop("n"), counted, hot)
    places = texts.select(F.col("uid").alias("stretch"), "places")
    # written, so that neither the links nor their shuffles are there while all comes back to the blocks
    summed = stage(found.select("stretch", "n_a", "groups").join(sums, "stretch").join(places, "stretch").select(*SENT, "groups", "places"), "summed")
    remove(spark, at["stretches"])
    remove(spark, at["groups"])
    let_go(spark)
    back = summed.select(*SENT, "groups", F.explode("places").alias("_at")).select(F.col("_at.block").alias("_block"), "_at.k", *SENT, "groups")
    return by_document(numbers, back)


def by_document(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """The sums and the digest of each document of block, doc_id, ks, over _block, k and what was found of that stretch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        k = right["k"].to_numpy()
        place = np.full(int(k.max(initial=-1)) + 1, -1, np.int32)
        place[k] = np.arange(len(k))
        groups = Groups(right["groups"])
        # a group of p and q tokens has p + q - 2 commas and p + q - 1 links
        own = [right["n_a"].to_numpy(), groups.signs(0xB), groups.signs(0xA), right["n_best"].to_numpy(), right["count_sum"].to_numpy()]
        doc_id = left["doc_id"]
        made, digests = np.zeros((len(left), len(own)), np.int64), [""] * len(left)
        for i, ks in enumerate(left["ks"]):
            if ks.is_valid:
                at = place[unpacked(ks.as_py())]
                made[i] = [x[at].sum(dtype=np.int64) for x in own]
                digests[i] = digest(groups.text(at[a : a + TAKEN]) for a in range(0, len(at), TAKEN))
        n_a, n_groups, commas, n_best, count_sum = made.T
        sums = n_a, commas + 2 * n_groups - n_a, n_groups, commas + n_groups, n_best, count_sum
        del right, groups, own
        give_back()
        return pa.table([doc_id, *map(pa.array, sums), pa.array(digests, pa.string())], ["doc_id", *COUNTS, "groups_sha256"])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string"
    return docs.groupBy("block").cogroup(stretches.groupBy("_block")).applyInArrow(run, schema)
