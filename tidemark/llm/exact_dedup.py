"""Exact deduplication over content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last 32 bytes says so, hence at the same
places wherever the same passage stands. A chunk's identifier is 64 bits of its digest; all chunks
that claim an identifier are then checked to have one SHA-256 digest, and where they don't, the
identifier is split. A document's recipe is its ordered list of identifiers: equal lists are equal
texts. Long documents are read once and never shuffled; identifiers and digests move in their place.

Defined cases: null and empty texts are equal (an empty recipe); rows that repeat one id and text
count in group_size and exactly one of them stays; a null id counts as smaller than any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import stage, with_likely, with_row
from tidemark.llm.words import blocks, map_batches, utf8

WINDOW, LEAST, MOST, MASK_BITS = 32, 512, 16384, 11
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def candidates(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of 32-byte windows whose hash marks a cut."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint32(step))
    return np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1


def cuts(marks: np.ndarray, length: int) -> list[int]:
    """Ends of the chunks of one text: marks at least LEAST bytes on, or MOST bytes on if there is none."""
    out, at, k = [], 0, 0
    while length - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = int(marks[k]) if k < len(marks) else length
        at = min(end, at + MOST, length)
        out.append(at)
    if at < length:
        out.append(length)
    return out


def recipes(docs: DataFrame, id_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _key, text_sha256 and the chunks (id, digest) of every text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            data = _LOWER[data]
            sha, ids, digests, n = [], [], [], [0]
            for a, b in blocks(off):
                part = data[off[a] : off[b]]
                marks = candidates(part)
                for i in range(a, b):
                    lo, hi = off[i] - off[a], off[i + 1] - off[a]
                    text = part[lo:hi]
                    sha.append(hashlib.sha256(text).hexdigest())
                    own = marks[np.searchsorted(marks, lo + WINDOW) : np.searchsorted(marks, hi, "right")] - lo
                    at = 0
                    for end in cuts(own, int(hi - lo)):
                        d = hashlib.sha256(text[at:end]).digest()
                        digests.append(d)
                        ids.append(int.from_bytes(d[:8], "big", signed=True) >> (64 - id_bits))
                        at = end
                    n.append(len(ids))
            chunks = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["id", "digest"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(n, pa.int32()), chunks)], [id_col, "_key", "text_sha256", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, row_key(id_col, text_col).alias("_key"))
    return map_batches(rows, run, f"{id_col} {kind}, _key string, text_sha256 string, chunks array<struct<id:bigint,digest:binary>>")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart that are not the same id and text."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(text_col).cast("string"))


def verified(made: DataFrame) -> DataFrame:
    """Recipes of identifiers that stand for one chunk each: column recipe in place of chunks."""
    chunk = made.select("_row", F.posexplode("chunks").alias("_pos", "_c")).select("_row", "_pos", "_c.id", "_c.digest")
    claims = chunk.groupBy("id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b")).where("_a <> _b").select("id")
    plain = made.withColumn("recipe", F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), F.lit(0).alias("variant"))))
    claims = stage(claims, "split-ids")
    if claims.isEmpty():
        return plain.drop("chunks")
    split = chunk.select("id", "digest").distinct().join(claims, "id", "left_semi")
    split = split.withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("digest")))
    own = chunk.join(split, ["id", "digest"], "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "id", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("_r"))
    named = F.transform("_r", lambda c: F.struct(c["id"].alias("id"), c["variant"].alias("variant")))
    return made.drop("chunks").join(own, "_row", "left").withColumn("recipe", F.coalesce(named, F.array().cast("array<struct<id:bigint,variant:int>>"))).drop("_r")


def decided(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, _key, text_sha256, keep_id, group_size, kept.

    Groups are counted before they meet, so a text that a third of the rows share is one row from
    each task; the join back to the documents moves ids and recipes only.
    """
    made = stage(recipes(docs, id_bits).withColumn("_row", F.monotonically_increasing_id()), "recipes")
    rows = verified(made)
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    groups = stage(groups, "groups")  # a table of its own, so that Spark can split a recipe with very many rows in the join
    return rows.join(groups, "recipe").select("doc_id", "_key", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    return decided(docs, id_bits).drop("_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns; of rows that repeat one id and text, one.

    Only documents that may have to go are shuffled, repeated rows as one from each task. Of the rows of
    an id and text at most one stays.
    """
    rows = decided(docs).groupBy("_key").agg(F.count("*").alias("_n"), F.count_if("kept").alias("_stay")).where("_stay < _n").select("_key", "_stay")
    rows = stage(rows, "dropped")
    marked = with_likely(with_row(docs, _key=row_key()), "_key", rows)
    some = marked.where("_likely").select("row", "_key").dropDuplicates(["_key"]).join(rows, "_key", "left")
    return marked.where("not _likely").select("row.*").unionByName(some.where("_stay is null or _stay > 0").select("row.*"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
