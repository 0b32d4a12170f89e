"""Toxicity by two interpolated Kneser-Ney bigram models, of toxic and of ordinary documents.

Within a class c, a word w after v has the probability
    p(w|v,c) = (1 - b(v)) s(w|v,c) + b(v) p(w|c)
    p(w|c)   = (1 - b) s(w|c) + b p(w)
    p(w)     = (N(w) + 1/V) / (N + 1)
where N counts the different words before w (continuations) and s is what absolute discounts leave:
    s(w|c)   = u(w,c) / u(c)                                   u(w,c)  = max(N(w,c) - d, 0)
    s(w|v,c) = (u(vw,c) + SHARED u(vw)/u(v)) / (u(v,c) + SHARED)   u(vw,c) = max(n(vw,c) - PAIR d, 0)
All discounted counts go to the backoff, whose weights b(v) and b are shared by the classes: an expression
that no class has above the discount has the same probability in both. Each p sums to 1.

The log-likelihoods of the classes are compared per word, over the whole text and over its runs of
SPANS words: a long text is toxic if a passage of it is, however much else it holds. The score is a
logistic of the text's mean difference and of its highest ones over runs.

The classifier is fitted on a bounded sample: of each class the ROWS labelled documents whose ids have
the smallest hashes, and of those as many as hold WORDS words together. The sample is cut into PARTS; each
part is scored by models of the other parts, one for each discount of DISCOUNTS. The discount whose logistic has
the least loss on these scores is taken, with its logistic; the model is then counted over the whole sample. It keeps only
expressions above the discount in a class, as all others have equal probabilities in both, is broadcast, and
scoring reads each text once without a shuffle. All texts are scored, whole.

Words are lower-cased (A-Z) runs of bytes other than white space, without leading or trailing ASCII
punctuation.

Defined cases: a null or empty text has differences of 0 and the score of those; without labelled
documents of both classes every score is 0; a null id or label is not learned from; ids labelled
twice with different labels count in both; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.language_id import fold
from tidemark.llm.storage import stage
from tidemark.llm.words import Words, give_back, map_batches, mix, parts

ROWS, WORDS, PARTS, THRESHOLD = 6000, 2_000_000, 4, 0.7
DISCOUNTS, PAIR, SHARED, SPANS = (1.0, 2.0, 4.0, 8.0, 16.0), 4, 1000, (1, 3, 10, 30)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x51A7)
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Bare(Words):
    """Words without the ASCII punctuation around them; those of nothing else are left out."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        super().__init__(data, off)
        if not len(self.starts):
            return
        plain = np.flatnonzero(~_PUNCT[data])
        if not len(plain):
            plain = np.array([len(data)])
        i = np.searchsorted(plain, self.starts)
        j = np.searchsorted(plain, self.ends) - 1
        keep = (i <= j) & (i < len(plain))
        row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))[keep]
        self.starts, self.ends = plain[i[keep]], plain[j[keep]] + 1
        self.first = np.searchsorted(row, np.arange(len(off)))


def words_and_pairs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it (a mark at a text's start) and of the pair; its row."""
    w = Bare(data, off)
    h = w.hashes(lower=True)
    n = np.diff(w.first)
    row = np.repeat(np.arange(len(n)), n)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[w.first[:-1][n > 0]] = _START
    return h, before, mix(before * _GOLDEN + h), row


def pair_counts(rows: DataFrame) -> DataFrame:
    """toxic, part, before, word, n over rows of toxic, part and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False) * PARTS + batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, off in parts(batch):
                h, before, pair, row = words_and_pairs(data, off)
                kind = kinds[a:b][row]
                for c in np.unique(kind):
                    its = np.flatnonzero(kind == c)
                    _, k, n = np.unique(pair[its], return_index=True, return_counts=True)
                    own = its[k]
                    same = (pa.array(np.full(len(k), x, np.int32)) for x in divmod(int(c), PARTS))
                    yield pa.RecordBatch.from_arrays([*same, pa.array(before[own].view(np.int64)), pa.array(h[own].view(np.int64)), pa.array(n.astype(np.int64))], ["toxic", "part", "before", "word", "n"])

    made = map_batches(rows.select("toxic", "part", "text"), run, "toxic int, part int, before long, word long, n long")
    return made.groupBy("toxic", "part", "before", "word").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, labels: DataFrame, held: int = 1, folds: int = 3, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """toxic, part (below PARTS) and text of the bounded sample.

    Each 16 bytes count as a word at least, so the bound holds for texts without white space too; a text that
    is over the whole bound alone is not learned from. Which documents are in is decided on ids and sizes.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = None
    for c in (0, 1):
        own = known.where(F.col("toxic") == c).withColumn("_order", order).orderBy("_order").limit(rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    # at most 2 x rows ids
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    n = F.greatest(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.ceil(F.octet_length("text") / 16))
    sizes = found.groupBy("toxic", "_order", "doc_id").agg(F.sum(n).alias("_n")).where(F.col("_n") <= words)
    through = F.sum("_n").over(Window.partitionBy("toxic").orderBy("_order", "doc_id"))
    taken = stage(sizes.withColumn("_through", through).where(F.col("_through") <= words).select("toxic", "_order", "doc_id"), "sample-ids")
    part = F.pmod(F.col("_order"), F.lit(PARTS)).cast("int")
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(taken), "doc_id").select("toxic", part.alias("part"), "text")


class Counts:
    """The sample's different pairs, and how often each is in each class and part."""

    def __init__(self, toxic: np.ndarray, part: np.ndarray, before: np.ndarray, word: np.ndarray, n: np.ndarray):
        before, word = before.view(np.uint64), word.view(np.uint64)
        self.pairs, at, place = np.unique(mix(before * _GOLDEN + word), return_index=True, return_inverse=True)
        self.words, w = np.unique(word[at], return_inverse=True)
        self.contexts, v = np.unique(before[at], return_inverse=True)
        self.word, self.context, self.place = w.astype(np.int32), v.astype(np.int32), place.astype(np.int32)
        self.toxic, self.part, self.n = toxic.astype(np.int8), part.astype(np.int8), n.astype(np.float32)

    def without(self, part: int | None) -> np.ndarray:
        """The pairs' counts in ordinary and toxic texts of all parts but one."""
        own = [(self.toxic == c) & (self.part != (-1 if part is None else part)) for c in (0, 1)]
        return np.stack([np.bincount(self.place[k], self.n[k], len(self.pairs)) for k in own])


class Model:
    """The expressions that are above the discount in a class, as sorted arrays of hashes, and their probabilities."""

    def __init__(self, counts: Counts, n: np.ndarray, discount: float):
        w, v, size = counts.word, counts.context, len(counts.contexts)
        seen = np.stack([np.bincount(w, n[c] > 0, len(counts.words)) for c in (0, 1)])
        above = np.maximum(seen - discount, 0)
        shared = (seen.sum(0) + 1 / (len(counts.words) + 1)) / (seen.sum() + 1)
        rest = 1 - above.sum() / max(seen.sum(), 1)
        u = np.maximum(n - PAIR * discount, 0)
        after = np.stack([np.bincount(v, u[c], size) for c in (0, 1)])
        both = after.sum(0)
        back = 1 - both / np.maximum(np.bincount(v, n.sum(0), size), 1)

        p = np.flatnonzero(u.any(0))
        c = np.unique(v[p])
        own = above.any(0)
        own[w[p]] = True
        k = np.flatnonzero(own)
        self.pairs, self.contexts, self.words = counts.pairs[p], counts.contexts[c], counts.words[k]
        self.backoff = np.append(back[c], 1.0)
        self.low, self.pair = [], []  # the last entries are for all others
        for x in (0, 1):
            left = above[x] / above[x].sum() if above[x].any() else above.sum(0) / max(above.sum(), 1e-9)
            self.low.append(np.append((1 - rest) * left[k] + rest * shared[k], 1.0))
            s = (u[x][p] + SHARED * u[:, p].sum(0) / both[v[p]]) / (after[x][v[p]] + SHARED)
            self.pair.append(np.append((1 - back[v[p]]) * s, 0.0))

    def differences(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text: 1, the mean over its words of log p(toxic) - log p(ordinary), and the highest means over runs."""
        h, before, pair, row = words_and_pairs(data, off)
        count = np.bincount(row, minlength=len(off) - 1)
        out = np.zeros((len(off) - 1, 2 + len(SPANS)))
        out[:, 0] = 1
        if not len(h):
            return out

        def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
            if not len(table):
                return np.full(len(keys), -1)
            i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            return np.where(table[i] == keys, i, -1)

        w, v, p = find(self.words, h), find(self.contexts, before), find(self.pairs, pair)
        ordinary, toxic = (np.log(np.maximum(self.pair[c][p] + self.backoff[v] * self.low[c][w], 1e-300)) for c in (0, 1))
        total = np.append(0, np.cumsum(toxic - ordinary))
        first = np.append(0, np.cumsum(count))
        out[:, 1] = (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
        at = np.arange(len(h))
        has = count > 0
        for k, span in enumerate(SPANS):
            mean = (total[np.minimum(at + span, first[row + 1])] - total[at]) / span
            out[has, 2 + k] = np.maximum.reduceat(mean, first[:-1][has])
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method on scaled features."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def learn(docs: DataFrame, labels: DataFrame, held: int = 1, folds: int = 3) -> tuple[Model, np.ndarray] | None:
    """The model and the logistic's weights; None if a class has no document to learn from."""
    rows = stage(sample(docs, labels, held, folds), "sample")
    # at most 2 x WORDS rows of 22 bytes
    t = pair_counts(rows).select(F.col("toxic").cast("byte"), F.col("part").cast("byte"), "before", "word", F.col("n").cast("int")).toArrow()
    if len(np.unique(t["toxic"].to_numpy())) < 2:
        return None
    counts = Counts(*(t[c].to_numpy() for c in ("toxic", "part", "before", "word", "n")))
    del t
    give_back()
    models = []
    for k in range(PARTS):
        n = counts.without(k)
        models.append([Model(counts, n, d) for d in DISCOUNTS])
    shared = docs.sparkSession.sparkContext.broadcast(models)
    wide = 2 + len(SPANS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for k in np.unique(part):
                its = batch.filter(pa.array(part == k))
                x = [np.hstack([m.differences(data, off) for m in shared.value[k]]) for _, _, data, off in parts(its)]
                yield pa.RecordBatch.from_arrays([its.column(0), pa.array(list(np.concatenate(x)), pa.list_(pa.float64()))], ["toxic", "x"])

    # at most 2 x ROWS documents
    rest = map_batches(rows.select("toxic", "part", "text"), features, "toxic int, x array<double>").orderBy("toxic", "x").collect()
    shared.destroy()
    y, x = np.array([r.toxic for r in rest], float), np.array([r.x for r in rest])
    best = None
    for i, d in enumerate(DISCOUNTS):
        own = x[:, i * wide : (i + 1) * wide]
        weights = logistic(own, y)
        loss = np.logaddexp(0, np.where(y == 1, -1, 1) * (own @ weights)).mean()
        if best is None or loss < best[0]:
            best = loss, d, weights
    model = Model(counts, counts.without(None), best[1])
    del counts, n
    give_back()
    return model, best[2]


def score(docs: DataFrame, learned: tuple[Model, np.ndarray] | None, keep: list[str], name: str = "_score") -> DataFrame:
    """The columns to keep and the score of every text, under a name that is none of theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, off in parts(batch):
                if shared.value is None:
                    out.append(np.zeros(len(off) - 1))
                else:
                    model, weights = shared.value
                    out.append(1 / (1 + np.exp(-np.clip(model.differences(data, off) @ weights, -50, 50))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.concatenate(out))], [*keep, name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, run, f"{kinds}, `{name}` double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, learn(docs, labels), ["doc_id"]).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, all columns."""
    name = "_score" + "_" * max(map(len, docs.columns))
    return score(docs, learn(docs, labels), docs.columns, name).where(F.col(name) < threshold).drop(name)
