"""Removal of repeated passages by matching statistics against suffix automata of reference shards.

Every document is streamed through suffix automata for the longest match that ends at each word, and
the maximal spans of at least SPAN words that also start elsewhere are removed. Sending every document
through the automata of all shards would cost the square of the corpus, so a reference shard is made
of what can match: each window of SPAN words is known by its anchor, the run of ANCHOR words in it with
the least hash, and equal windows have equal anchors. Stretches of words around anchors that occur
twice or more go to the shard of their anchor; windows that repeat meet in one automaton, and no
document meets a shard that it shares nothing with.

A shard holds each different stretch once, with its number of copies, so a passage that a third of
all documents share is a few rows. An anchor that stands in very many different surroundings (over
CROWD stretches) would still fill its shard: its stretches are sent on window by window, to shards
by the windows' own words. Words are compared as themselves; hashes only choose what meets. (Stretches
are matched back to documents by a 128-bit digest.)

Windows are judged on the input: all occurrences of a repeated window go, in all documents.

Defined cases: a null or empty text, or one under SPAN words, keeps all its words; rows that repeat an
id and text are occurrences of their own, so each loses the windows it shares; a null id is a value
like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import likely_in, stage
from tidemark.llm.words import Words, grams, map_batches, parts

SPAN, ANCHOR, CROWD, SHARD_ROWS = 35, 12, 2000, 4000


def row_key() -> list:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("print")]


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w consecutive values, the first of equal ones."""
    if len(h) < w:
        return np.empty(0, np.int64)
    at = np.arange(len(h))
    width = 1
    while width < w:
        step = min(width, w - width)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        width += step
    return at


class Windows:
    """The windows of some texts and their anchors: own is each window's first word, anchor its anchor's."""

    def __init__(self, data: np.ndarray, off: np.ndarray, span: int, k: int):
        self.words = w = Words(data, off)
        g = grams(w.hashes(), k)
        n = np.diff(w.first)
        row = np.repeat(np.arange(len(n)), n)
        own = np.arange(max(0, len(row) - span + 1))
        self.own = own[row[own] == row[own + span - 1]] if len(own) else own
        self.anchor = sliding_least(g, span - k + 1)[self.own] if len(self.own) else self.own
        self.row = row[self.own]
        # runs of windows with one anchor
        new = np.ones(len(self.own), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        self.start = np.flatnonzero(new)
        self.length = np.diff(np.append(self.start, len(self.own)))
        self.hash = g[self.anchor[self.start]].view(np.int64) if len(self.start) else np.empty(0, np.int64)
        self.first = np.searchsorted(self.row[self.start], np.arange(len(off)))  # runs of each row

    def stretch(self, run: int, span: int) -> bytes:
        """The words of a run's windows, joined by one space."""
        a, b = self.own[self.start[run]], self.own[self.start[run]] + self.length[run] - 1 + span
        w = self.words
        raw = w.data[w.starts[a] : w.ends[b - 1]].tobytes()
        return b" ".join(raw.split())


def survey(docs: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, id, print, n_words, sha (of all words) and the anchors of every document, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, at, anchors = [], [], [0], [np.empty(0, np.int64)]
            for _, _, data, off in parts(batch):
                w = Windows(data, off, span, k)
                n += np.diff(w.words.first).tolist()
                sha += [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
                at += (at[-1] + w.first[1:]).tolist()
                anchors.append(w.hash)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(anchors)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], ["doc_id", "id", "print", "n_words", "sha", "anchors"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", *row_key(), "text"), run, f"doc_id {kind}, id string, print long, n_words long, sha string, anchors array<long>")


STRETCH = "id string, print long, run int, route long, digest binary"


def stretches(texts: DataFrame, span: int, k: int, words: bool) -> DataFrame:
    """The stretches around the runs named in texts (id, print, text, runs); with their words if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3).to_pylist()
            for a, _, data, off in parts(batch):
                w = Windows(data, off, span, k)
                rows, which, route, digest, raw = [], [], [], [], []
                for i in range(len(off) - 1):
                    for r in runs[a + i]:
                        s = w.stretch(w.first[i] + r, span)
                        rows.append(a + i)
                        which.append(r)
                        route.append(w.hash[w.first[i] + r])
                        digest.append(hashlib.blake2b(s, digest_size=16).digest())
                        raw.append(s)
                take = pa.array(rows, pa.int64())
                head = [] if words else [batch.column(0).take(take), batch.column(1).take(take), pa.array(which, pa.int32())]
                out = [*head, pa.array(route, pa.int64()), pa.array(digest, pa.binary()), *([pa.array(raw, pa.binary())] if words else [])]
                yield pa.RecordBatch.from_arrays(out, ["route", "digest", "words"] if words else ["id", "print", "run", "route", "digest"])

    return map_batches(texts.select("id", "print", "text", "runs"), run, "route long, digest binary, words binary" if words else STRETCH)


class Automaton:
    """A suffix automaton of several word lists, each counted with its copies.

    States hold the length of their longest string, a suffix link, the words that lead on, and how
    often their strings occur.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, copies: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self.split(last, w, q)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                count.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    link.append(0)
                else:
                    q = nxt[p][w]
                    link.append(0)  # in place before the split adds a state
                    link[cur] = q if length[q] == length[p] + 1 else self.split(p, w, q)
                last = cur
            count[last] += copies

    def split(self, p: int, w, q: int) -> int:
        """A copy of q for the strings that are no longer than p's followed by w."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def finish(self) -> None:
        """Add the counts of longer strings to those of their suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list, span: int) -> list[int]:
        """Ends of the runs of span words of a list that is in the automaton which occur twice or more.

        The list's own words are always matched in full, so the matching statistic at each place is
        cut back to span words, and the state there tells how often these occur.
        """
        out, s, nxt, link, length = [], 0, self.next, self.link, self.length
        for i, w in enumerate(words):
            s = nxt[s][w]
            while length[link[s]] >= span:
                s = link[s]
            if i + 1 >= span and self.count[s] > 1:
                out.append(i)
        return out


def judged(rows: DataFrame, span: int, shards: int) -> DataFrame:
    """route, digest, hits: of each different stretch (route, digest, words, n) the windows that repeat."""

    def judge(t: pa.Table) -> pa.Table:
        lists = [x.split(b" ") for x in t["words"].to_pylist()]
        copies = t["n"].to_pylist()
        # windows belong to one stretch each, but the stretches of an anchor overlap with those of
        # others of the shard: automata are made anchor by anchor
        by: dict[int, list[int]] = {}
        for i, r in enumerate(t["route"].to_pylist()):
            by.setdefault(r, []).append(i)
        hits: list[list[int]] = [[] for _ in lists]
        for group in by.values():
            if len(group) == 1:
                if copies[group[0]] > 1:
                    hits[group[0]] = list(range(len(lists[group[0]]) - span + 1))
                continue
            a = Automaton()
            for i in group:
                a.add(lists[i], copies[i])
            a.finish()
            for i in group:
                hits[i] = [e - span + 1 for e in a.repeated(lists[i], span)]
        return pa.table([t["route"], t["digest"], pa.array(hits, pa.list_(pa.int32()))], names=["route", "digest", "hits"])

    return rows.withColumn("shard", F.pmod(F.hash("route"), F.lit(shards))).groupBy("shard").applyInArrow(judge, "route long, digest binary, hits array<int>")


def single_windows(rows: DataFrame, span: int) -> DataFrame:
    """The windows of stretches (route, digest, words, n) as stretches of their own, with where they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for route, digest, words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words.split(b" ")
                for i in range(len(w) - span + 1):
                    s = b" ".join(w[i : i + span])
                    d = hashlib.blake2b(s, digest_size=16).digest()
                    for column, x in zip(out, (route, digest, i, int.from_bytes(d[:8], "big", signed=True), d, s, n), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["from_route", "from_digest", "at", "route", "digest", "words", "n"])

    return map_batches(rows.select("route", "digest", "words", "n"), run, "from_route long, from_digest binary, at int, route long, digest binary, words binary, n long")


def repeated_windows(distinct: DataFrame, span: int, crowd: int, shard_rows: int) -> DataFrame:
    """route, digest, hits of the different stretches that have repeated windows."""
    per = distinct.groupBy("route").agg(F.count("*").alias("kinds"))
    crowded = stage(per.where(F.col("kinds") > crowd).select("route"), "crowded")
    total = distinct.count()
    plain = distinct.join(crowded, "route", "left_anti") if not crowded.isEmpty() else distinct
    found = judged(plain, span, max(1, total // shard_rows))
    if not crowded.isEmpty():
        single = stage(single_windows(distinct.join(crowded, "route", "left_semi"), span), "single-windows")
        kinds = single.groupBy("route", "digest", "words").agg(F.sum("n").alias("n"))
        hit = judged(kinds, span, max(1, kinds.count() // shard_rows)).where(F.size("hits") > 0).select("route", "digest")
        back = single.join(hit, ["route", "digest"], "left_semi").groupBy("from_route", "from_digest").agg(F.collect_set("at").alias("hits"))
        found = found.unionByName(back.select(F.col("from_route").alias("route"), F.col("from_digest").alias("digest"), "hits"))
    return found.where(F.size("hits") > 0)


def cut(texts: DataFrame, span: int, k: int) -> DataFrame:
    """id, print, n_removed, kept_sha256, kept of texts (id, print, text, found: run and its repeated windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3).to_pylist()
            for a, b, data, off in parts(batch):
                w = Windows(data, off, span, k)
                removed, sha, kept = [], [], []
                for i in range(b - a):
                    lo, hi = w.words.first[i], w.words.first[i + 1]
                    edge = np.zeros(hi - lo + 1, np.int64)
                    for x in found[a + i]:
                        at = w.own[w.start[w.first[i] + x["run"]]] - lo + np.array(x["hits"], np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + span, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = data[off[i] : off[i + 1]].tobytes().split()
                    text = b" ".join([x for x, y in zip(words, stay, strict=True) if y])
                    removed.append(int((~stay).sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["id", "print", "n_removed", "kept_sha256", "kept"])

    return map_batches(texts.select("id", "print", "text", "found"), run, "id string, print long, n_removed long, kept_sha256 string, kept string")


def removals(docs: DataFrame, span: int = SPAN, k: int = ANCHOR, crowd: int = CROWD, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, id, print, n_words, sha), and those of them that lose words with what is kept."""
    key = ["id", "print"]
    made = stage(survey(docs, span, k), "survey")
    anchor = made.select(*key, F.posexplode("anchors").alias("run", "anchor"))
    # a table of its own, so that the join deals out anew and Spark can split an anchor with very many rows
    often = stage(anchor.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    runs = anchor.join(often, "anchor", "left_semi").groupBy(key).agg(F.collect_set("run").alias("runs"))
    runs = stage(runs.withColumn("doc", F.xxhash64(*key)), "runs")
    rows = docs.select(*row_key(), "text").withColumn("doc", F.xxhash64(*key))
    texts = stage(likely_in(rows, "doc", runs).join(runs.drop("doc"), key).select(*key, "text", "runs"), "texts")
    distinct = stretches(texts, span, k, True).groupBy("route", "digest", "words").agg(F.count("*").alias("n"))
    distinct = stage(distinct, "stretches")
    hits = stage(repeated_windows(distinct, span, crowd, shard_rows), "hits")
    found = stretches(texts, span, k, False).join(hits, ["route", "digest"]).groupBy(key).agg(F.collect_set(F.struct("run", "hits")).alias("found"))
    return made, stage(cut(texts.select(*key, "text").join(found, key), span, k), "cut")


def op5(docs: DataFrame) -> DataFrame:
    made, changed = removals(docs)
    changed = changed.select("id", "print", "n_removed", "kept_sha256").distinct()
    rows = made.select("doc_id", "id", "print", "n_words", "sha").join(changed, ["id", "print"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM t, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM r, range(35) AS x(k)),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
k AS (SELECT v.doc_id, count(*) FILTER (c.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY v.pos) FILTER (c.pos IS NULL) AS kept FROM v LEFT JOIN c ON c.doc_id = v.doc_id AND c.pos = v.pos GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
