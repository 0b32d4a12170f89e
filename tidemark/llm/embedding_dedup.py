"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Vectors are scaled to length 1 and turned into the principal axes of a sample, which leaves their
products as they are and puts most of them into the leading coordinates. A pair's product over the
leading coordinates plus the product of the two norms of the rest bounds its cosine: pairs whose bound
is under the threshold are dropped after 8, 16 or 32 coordinates, and only what is left is summed up
in double precision. The first of these bounds is the one that leaves few of the sample's pairs.

Vectors are compared tile by tile, some TILE of them against some TILE. Tiles are ranges of the first
coordinate, split by hash where a range holds more, so tiles too far apart in it are never paired. Tiles
are written once. A task takes two parts of that table, each read where it lies, and pairs their tiles, so
no pair is shuffled or written, and any task holds two parts. It returns a row for each vector that has
links, with their number and one link to the root of its part, not the pairs themselves.

The comparison is exact, so its work grows with the square of the number of different vectors, less
what the first coordinate rules out; its disk grows with the vectors and with the rows of those that have
links, at most one in each task. Equal vectors are one from their tile on. Whatever tells whether two
vectors are equal, or which tile they belong to, is the same for equal vectors to the last bit. Vectors of
each length (of each embedding model) have axes and tiles of their own and are compared length by length;
the table is read once, and three times more for each length, but its vectors are shuffled and written once.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing
(n_links 0, their own component), and vectors of different lengths not with each other; equal vectors
link with each other; rows that repeat an id count as vectors of their own; a null id makes no links; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import stage
from tidemark.llm.words import map_batches

THRESHOLD, TILE, RANGES, SAMPLE, LEADS, ROWS_AT_ONCE, SLACK, FEW = 0.95, 4096, 256, 4096, (8, 16, 32), 256, 1e-5, 0.01


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of all lists, where each list's begin (one more entry at the end) and which lists can link."""
    x = column.values.to_numpy(zero_copy_only=False)  # a null is a NaN
    x = (x if x.dtype == np.float32 else x.astype(np.float64)) + np.float32(0)  # no zero has a sign
    off = column.offsets.to_numpy()
    inside = lambda fits: np.diff(np.concatenate([[0], np.cumsum(fits)])[off])
    return x, off, column.is_valid().to_numpy(zero_copy_only=False) & (inside(np.isfinite(x)) == np.diff(off)) & (inside(x != 0) > 0)


def digest_of(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, and of the vectors that can link d (number of components) and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, off, good = listed(batch.column(1))
            good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            d = pa.array(np.diff(off).astype(np.int32), mask=~good)
            digest = [digest_of(x[off[i] : off[i + 1]]) if g else None for i, g in enumerate(good)]
            yield pa.RecordBatch.from_arrays([batch.column(0), d, pa.array(digest, pa.binary())], ["vec_id", "d", "digest"])

    return map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, d int, digest binary")


def unit(raw: np.ndarray) -> np.ndarray:
    """The rows at length 1; what a row gives doesn't depend on the rows beside it."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps the squares in range
    return x / np.sqrt(np.add.accumulate(x * x, 1)[:, -1:])


def doubles_or_floats(raw: bytes, rows: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * d else np.float64).reshape(rows, d)


class Axes:
    """Principal axes, the ranges of the first coordinate and the first step to take, from a sample of at most SAMPLE vectors."""

    def __init__(self, sample: np.ndarray, threshold: float):
        x = unit(sample)
        _, v = np.linalg.eigh(x.T @ x)
        self.turn = np.ascontiguousarray(v[:, ::-1])
        self.edges = np.unique(np.quantile(x @ self.turn[:, 0], np.arange(1, RANGES) / RANGES))
        leads = Turned(sample[:1024], self).leads
        self.start = next((k for k, p in enumerate(leads) if np.mean(p @ p.T >= threshold - SLACK) < FEW), max(0, len(leads) - 1))

    def range_of(self, x: np.ndarray) -> np.ndarray:
        # a matrix product's last bits could change with the rows beside
        return np.searchsorted(self.edges, np.add.accumulate(x * self.turn[:, 0], 1)[:, -1], "right")


def merged(vectors: DataFrame, d: int, axes: Broadcast[Axes] | None = None) -> DataFrame:
    """digest, rep, n, range and raw of the vectors of d components, each once a batch, so that one of very many copies fills no tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, off, good = listed(batch.column(1))
            good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            x, ids = x[off[0] : off[-1]].reshape(-1, d)[good] if len(batch) else np.zeros((0, d)), batch.column(0).filter(pa.array(good)).to_numpy()
            places: dict[bytes, int] = {}
            place = np.array([places.setdefault(digest_of(v), len(places)) for v in x], np.int64)
            _, first, n = np.unique(place, return_index=True, return_counts=True)
            rep = np.full(len(places), np.iinfo(np.int64).max)
            np.minimum.at(rep, place, ids)
            r = axes.value.range_of(unit(x[first])) if axes and len(first) else np.zeros(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.binary()), pa.array(rep), pa.array(n.astype(np.int64)), pa.array(r.astype(np.int32)), pa.array([v.tobytes() for v in x[first]], pa.binary())], ["digest", "rep", "n", "range", "raw"])

    own = vectors.where(F.size("embedding") == d).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return map_batches(own, run, "digest binary, rep long, n long, range int, raw binary")


class Tiles:
    """Numbers of the tiles of each range, in order of the first coordinate, and which pair with which."""

    def __init__(self, rows: dict[int, int], edges: np.ndarray, tile: int, threshold: float):
        n = len(edges) + 1
        # neighbouring ranges share a tile until it is full
        self.first, self.split = np.zeros(n, np.int64), np.ones(n, np.int64)
        low, high, at, held = [], [], -1, 0
        for r in range(n):
            k = rows.get(r, 0)
            a, b = (edges[r - 1] if r else -1.0), (edges[r] if r < n - 1 else 1.0)
            if at < 0 or held + k > tile:
                self.split[r] = max(1, -(-k // tile))
                at += 1
                self.first[r] = at
                at += int(self.split[r]) - 1
                low += [a] * int(self.split[r])
                high += [b] * int(self.split[r])
                held = k if self.split[r] == 1 else tile
            else:
                self.first[r] = at
                high[at] = b
                held += k
        reach = np.sqrt(2 - 2 * threshold) + 1e-6
        low_, high_ = np.array(low), np.array(high)
        self.last = np.searchsorted(low_, high_ + reach, "right") - 1  # the last tile near enough to each
        self.least = np.searchsorted(np.maximum.accumulate(self.last), np.arange(len(low)), "left")


def blocks(rows: DataFrame, axes: Axes, tile: int, threshold: float) -> DataFrame:
    """One row per tile: tile, last and least partner, reps, their counts and vectors (as they came), of rows of ``merged``."""
    tiles = Tiles({r[0]: r[1] for r in rows.groupBy("range").count().collect()}, axes.edges, tile, threshold)
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("range") + 1)
    placed = rows.withColumn("tile", (pick(tiles.first) + F.pmod(F.xxhash64("digest"), pick(tiles.split))).cast("int"))

    def gather(t: pa.Table) -> pa.Table:
        k = t["tile"][0].as_py()
        places: dict[bytes, int] = {}
        place = np.array([places.setdefault(v, len(places)) for v in t["digest"].to_pylist()], np.int64)
        reps, counts = np.full(len(places), np.iinfo(np.int64).max), np.zeros(len(places), np.int64)
        np.minimum.at(reps, place, t["rep"].to_numpy())
        np.add.at(counts, place, t["n"].to_numpy())
        x = b"".join(t["raw"].take(np.unique(place, return_index=True)[1]).to_pylist())
        return pa.table({"tile": [k], "last": [int(tiles.last[k])], "least": [int(tiles.least[k])], "reps": [reps], "counts": [counts], "x": [x]}, schema=pa.schema({"tile": pa.int32(), "last": pa.int32(), "least": pa.int32(), "reps": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "x": pa.binary()}))

    return placed.groupBy("tile").applyInArrow(gather, "tile int, last int, least int, reps array<long>, counts array<long>, x binary")


class Turned:
    """The vectors of a tile, of length 1 and on the principal axes; for each step their leading coordinates and the norm of the rest."""

    def __init__(self, raw: np.ndarray, axes: Axes):
        self.x = unit(raw) @ axes.turn
        leads = [np.column_stack([self.x[:, :m], np.sqrt((self.x[:, m:] ** 2).sum(1))]) for m in LEADS if m < self.x.shape[1]]
        self.leads = [p.astype(np.float32) for p in leads]


def linked(a: Turned, b: Turned, at: int, start: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of cosine at or over the threshold, for ROWS_AT_ONCE rows of a."""
    own = slice(at, at + ROWS_AT_ONCE)
    all_pairs = left = len(a.x[own]) * len(b.x)
    i = j = np.zeros(0, np.int64)
    for p, q in zip(a.leads[start:], b.leads[start:], strict=True):
        if left > FEW * all_pairs:  # whole products are cheaper
            i, j = np.nonzero(p[own] @ q.T >= threshold - SLACK)
            i = i + at
        else:
            keep = np.einsum("ij,ij->i", p[i], q[j]) >= threshold - SLACK
            i, j = i[keep], j[keep]
        left = len(i)
    if left * 8 > all_pairs:
        i, j = np.nonzero(a.x[own] @ b.x.T >= threshold)
        return i + at, j
    keep = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= threshold
    return i[keep], j[keep]


class Roots:
    """Union-find over the vectors of some tiles."""

    def __init__(self, n: int = 0):
        self.up = np.arange(n)

    def add(self, n: int) -> None:
        self.up = np.concatenate([self.up, np.arange(len(self.up), len(self.up) + n)])

    def find(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the ends of links: first each i with one j and each j with one i, then what is still apart."""
        for k in (np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1], slice(None)):
            root = self.find()
            a, b = root[i[k]], root[j[k]]
            apart = np.unique(np.column_stack([a, b])[a != b], axis=0)
            for x, y in apart:
                while self.up[x] != x:
                    x = self.up[x]
                while self.up[y] != y:
                    y = self.up[y]
                self.up[max(x, y)] = min(x, y)


def links_of(a: Turned, b: Turned, n_a: np.ndarray, n_b: np.ndarray, start: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of two tiles, or of one with itself, how many links each has between them, and the root of its part."""
    same, shift = a is b, 0 if a is b else len(a.x)
    links, roots = np.zeros(shift + len(b.x), np.int64), Roots(shift + len(b.x))
    for at in range(0, len(a.x), ROWS_AT_ONCE):
        i, j = linked(a, b, at, start, threshold)
        if same:
            i, j = i[i != j], j[i != j]
        if len(i):
            links[: len(a.x)] += np.bincount(i, n_b[j], len(a.x)).astype(np.int64)
            if not same:
                links[shift:] += np.bincount(j, n_a[i], len(b.x)).astype(np.int64)
            roots.join(i, j + shift)
    return links, roots.find()


def compare(pairs: DataFrame, d: int, axes: Broadcast[Axes], threshold: float) -> DataFrame:
    """rep, root, links: of each vector with links in a task's pairs of tiles, how many, and the root of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, int] = {}  # of each tile's vectors among all of the task
        all_reps, all_links, all_roots, held, a = np.zeros(0, np.int64), np.zeros(0, np.int64), Roots(), None, None
        for batch in batches:
            for k in range(len(batch)):
                t, u = (batch.column(c)[k].as_py() for c in "tu")
                (reps_t, reps_u), (counts_t, counts_u) = ([batch.column(f"{c}_{e}")[k].values.to_numpy() for e in "tu"] for c in ("reps", "counts"))
                if t != held:  # it comes with all its partners one after another
                    held, a = t, Turned(doubles_or_floats(batch.column("x_t")[k].as_py(), len(reps_t), d), axes.value)
                b = a if t == u else Turned(doubles_or_floats(batch.column("x_u")[k].as_py(), len(reps_u), d), axes.value)
                both = {t: reps_t, u: reps_u}
                for e, reps in both.items():
                    if e not in starts:
                        starts[e] = len(all_reps)
                        all_reps, all_links = np.concatenate([all_reps, reps]), np.concatenate([all_links, np.zeros(len(reps), np.int64)])
                        all_roots.add(len(reps))
                links, roots = links_of(a, b, counts_t, counts_u, axes.value.start, threshold)
                has = links > 0
                place = np.concatenate([np.arange(starts[e], starts[e] + len(reps)) for e, reps in both.items()])
                all_links[place] += links
                all_roots.join(place[has], place[roots[has]])
        has, roots = all_links > 0, all_roots.find()
        yield pa.RecordBatch.from_arrays([pa.array(all_reps[has]), pa.array(all_reps[roots[has]]), pa.array(all_links[has])], ["rep", "root", "links"])

    return map_batches(pairs, run, "rep long, root long, links long")


def paired(tiles: DataFrame) -> DataFrame:
    """Each two tiles that are near enough, once: their numbers t and u, reps, counts and vectors.

    Spark's nested loops read two parts of the table in each task, so nothing is shuffled, where a join by
    numbers would send each tile once per partner. Which of two tiles is t alternates, so no task has all pairs of its parts and another none.
    """
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("reps", "counts", "x")]
    left = tiles.select(F.col("tile").alias("t"), "least", "last", *side("t"))
    right = tiles.select(F.col("tile").alias("u"), *side("u"))
    once = (F.col("t") == F.col("u")) | ((F.col("t") < F.col("u")) == ((F.col("t") + F.col("u")) % 2 == 0))
    return left.hint("shuffle_replicate_nl").join(right, F.col("u").between(F.col("least"), F.col("last")) & once).drop("least", "last")


def axes_of(vectors: DataFrame, different: DataFrame, d: int, threshold: float) -> Axes:
    """Of the SAMPLE vectors of d components whose digests hash least."""
    hashes = different.where(F.col("d") == d).select(F.xxhash64("digest").alias("h"))
    most = hashes.orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = merged(vectors, d).where(F.xxhash64("digest") <= most).groupBy("digest").agg(F.first("raw").alias("raw")).toArrow().sort_by("digest")
    return Axes(doubles_or_floats(b"".join(sample["raw"].to_pylist()), len(sample), d), threshold)


def links_of_length(vectors: DataFrame, different: DataFrame, d: int, threshold: float, tile: int) -> DataFrame:
    """rep, root, links of the different vectors that all have d components."""
    axes = vectors.sparkSession.sparkContext.broadcast(axes_of(vectors, different, d, threshold))
    tiles = stage(blocks(merged(vectors, d, axes), axes.value, tile, threshold), "tiles")
    return stage(compare(paired(tiles), d, axes, threshold), "tile-links")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    every = stage(usable(vectors), "vectors")
    good = every.where("digest is not null")
    different = stage(good.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("d").alias("d")), "different")
    # a vector that is the only one of its length has nothing to be compared with
    lengths = [r[0] for r in different.groupBy("d").count().where("count > 1").orderBy("d").collect()]
    found = every.sparkSession.createDataFrame([], "rep long, root long, links long")
    for d in lengths:
        found = found.unionByName(links_of_length(vectors, different, d, threshold, tile))
    named = different.select("digest", "rep", "n")
    named = named.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(components(found, "rep", "root").withColumnRenamed("node", "rep"), "rep", "left")
    named = stage(named.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    rows = every.select("vec_id", "digest").join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND a.size > 0 AND b.size > 0 AND list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(n_links), 0) AS n_links, min(root) AS component_id, r.vec_id = min(root) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""
