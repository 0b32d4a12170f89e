"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its 5-word shingles (64-bit hashes). Shingles fall on D places, which a first
permutation scatters; coordinate k of the signature is the least value that a second permutation,
shifted round by k, gives to the document's places. So two permutations make all the coordinates.
32 bands of 4 coordinates miss a pair of similarity 0.75 with a probability of about 5e-6.

Documents of one set are one class from the start. In each bucket of a band, every class is compared
with one leader, the class that shares most with others. Where a bucket then still holds classes
outside the leader's component, each of these is held against the bucket's classes in other components
by all SIGNATURE coordinates (4 bits of each), once for a pair whatever buckets it shares; pairs that
agree in LEAST_EQUAL of them or more are compared. A pair of similarity 0.75 agrees in fewer with a
probability of about 4e-6. So groups of thousands of copies cost a comparison each and not all their
pairs. All links are confirmed on full sets.

Defined cases: a null text, or one without words, has no shingles and links with nothing; one of fewer
than 5 words is one shingle, its whole sequence; rows that repeat an id are one node, and rows that
repeat a text are linked; a null
id is a document of its own, linked with nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import likely_in, stage, with_likely, with_row
from tidemark.llm.words import Words, grams, map_batches, mix, parts

SHINGLE, LEAST_HUNDREDTHS = 5, 75
PLACES, BANDS, BAND_ROWS, SIGNATURE, LEAST_EQUAL = 1 << 20, 32, 4, 512, 349
_tables: dict = {}


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(data, off)
    h = w.hashes(lower=True)
    g = grams(h, k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        else:
            yield grams(h[a:b], int(b - a)) if b > a else h[:0]


def permutations(n: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second with each place's n shifted values in a row."""
    if n not in _tables:
        rng = np.random.Generator(np.random.PCG64(99))
        first, second = rng.permutation(PLACES).astype(np.int32), rng.permutation(PLACES).astype(np.int32)
        _tables[n] = (first, np.lib.stride_tricks.sliding_window_view(np.append(second, second[:n]), n))
    return _tables[n]


def signature(hashes: np.ndarray) -> np.ndarray:
    first, shifted = permutations()
    at = np.unique(first[(hashes >> np.uint64(44)).astype(np.int64)])
    out = shifted[at[:256]].min(0)
    for i in range(256, len(at), 256):  # in steps that stay in the cache
        out = np.minimum(out, shifted[at[i : i + 256]].min(0))
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates and its number."""
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)[:, k].astype(np.uint64))
    return out.view(np.int64)


def nibbles(values: np.ndarray) -> np.ndarray:
    """4 bits of a hash of each coordinate, 16 in a long."""
    four = mix(values.astype(np.uint64)).reshape(-1, 16) & np.uint64(15)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def equal_coordinates(a: str, b: str) -> Column:
    """How many of the 4-bit coordinates of two columns are equal."""
    differ = "(x ^ y | shiftrightunsigned(x ^ y, 1) | shiftrightunsigned(x ^ y, 2) | shiftrightunsigned(x ^ y, 3)) & 1229782938247303441"
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> 16 - bit_count({differ})), 0, (m, k) -> m + k)")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that stand for the set), bands and bits (the signature's) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sa, sb, flat, bits = [], [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, _, data, off in parts(batch):
                for s in shingles(data, off):
                    n.append(len(s))
                    sa.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    sb.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5))).astype(np.int64)) if len(s) else 0)
                    if len(s):
                        values = signature(s)
                        flat.append(bands(values))
                        bits.append(nibbles(values))
            at = np.append(0, np.cumsum(np.array(n) > 0) * BANDS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at // BANDS * k), pa.array(np.concatenate(x))) for k, x in ((BANDS, flat), (SIGNATURE // 16, bits))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), *lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep and set (sorted distinct hashes) of documents with rep and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in parts(batch):
                sets = list(shingles(data, off))
                at = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "set"])

    return map_batches(docs.select("rep", "text"), run, f"rep {docs.schema['rep'].dataType.simpleString()}, set array<long>")


def similar(na: Column, nb: Column, both: Column) -> Column:
    return both * 100 >= (na + nb - both) * LEAST_HUNDREDTHS


def could_be(na: Column, nb: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * LEAST_HUNDREDTHS


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.

    Only texts of documents in a pair are shuffled; their sets are then joined to the pairs.
    """
    pairs = stage(pairs, "pairs")
    ids = stage(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "paired")
    texts = likely_in(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", ids).join(ids, "rep", "left_semi")
    sets = stage(full_sets(texts), "sets")
    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    n = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(similar(F.size("set_a"), F.size("set_b"), n)).select("a", "b")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between classes (rep, n, bands, bits) that make their components."""
    member = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = stage(member.join(sizes, "bucket"), "members")
    shares = member.groupBy("rep").agg(F.sum("size").alias("shares"))
    order = F.struct((-F.col("shares")).alias("_s"), F.xxhash64("rep").alias("_o"), F.col("rep").alias("rep"), F.col("n").alias("n"))
    lead = stage(member.join(shares, "rep").groupBy("bucket").agg(F.min(order).alias("lead")), "leaders")
    led = member.join(lead, "bucket").select("bucket", "rep", "n", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"))
    pairs = led.where((F.col("rep") != F.col("lead")) & could_be(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    found = stage(confirmed(pairs, docs), "links")
    comp = stage(components(found), "components")
    led = led.join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left")
    led = led.join(comp.select(F.col("node").alias("lead"), F.col("component").alias("lead_c")), "lead", "left")
    led = stage(led.select("bucket", "rep", "n", F.coalesce("c", "rep").alias("c"), F.coalesce("lead_c", "lead").alias("lead_c"), "lead"), "led")
    # where a bucket still holds several components, those outside the leader's meet the others
    outside = led.where("c <> lead_c")
    open_ = stage(outside.select("bucket").distinct(), "open-buckets")
    inside = led.join(open_, "bucket", "left_semi")
    sketch = classes.select("rep", "bands", "bits")
    x = outside.join(sketch, "rep").select("bucket", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("bands").alias("bands_a"), F.col("bits").alias("bits_a"))
    y = inside.where("rep <> lead").join(sketch, "rep")
    once = F.array_min(F.array_intersect("bands_a", "bands")) == F.col("bucket")
    meet = (F.col("ca") != F.col("c")) & could_be(F.col("na"), F.col("n")) & ((F.col("c") == F.col("lead_c")) | (F.col("a") < F.col("rep")))
    more = stage(x, "outside").join(stage(y, "inside"), "bucket").where(meet & (equal_coordinates("bits_a", "bits") >= LEAST_EQUAL) & once)
    more = more.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    return found.unionByName(stage(confirmed(more, docs), "more-links"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    made = stage(sketches(docs), "sketches")
    own = made.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    least = own.groupBy(key).agg(F.min(F.struct("doc_id", "bands", "bits")).alias("_m")).select(*key, "_m.bands", "_m.bits", F.col("_m.doc_id").alias("rep"))
    least = stage(least, "classes")
    comp = components(links(least.select("rep", F.col("n_shingles").alias("n"), "bands", "bits"), docs))
    named = least.drop("bands", "bits").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    rows = made.drop("bands", "bits").join(stage(named, "named"), key, "left")
    rows = rows.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns: one id of each component, and those without an id.

    Only documents that may have to go are shuffled.
    """
    dropped = stage(dedup(docs).where("not kept").select("doc_id").distinct(), "dropped")
    marked = with_likely(with_row(docs, doc_id=F.col("doc_id")), "doc_id", dropped)
    some = marked.where("_likely").join(dropped, "doc_id", "left_anti")
    return marked.where("not _likely").select("row.*").unionByName(some.select("row.*"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
