"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of a trigram is the product of its letters'
vectors, the first rotated by two places and the second by one; a text is the sum of its trigrams'
vectors, a language the sum of its texts. A text gets the language whose sum has the largest cosine
with its own.

Texts are lower-cased letter by letter; whatever is not a letter separates words and is one more
letter. A letter's vector is hashed from its code point, so every letter of every script has its own
and no table of them is kept. Each task sums the vectors of its texts by language in whole numbers;
these sums (languages x DIMENSIONS numbers, whatever the alphabets) are what is shuffled and what the
driver gets.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the first
language by code point; with no labelled row everything is ``und``; a null id is neither learned from
nor held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import map_batches, mix, parts

DIMENSIONS, SEED, CELLS, STEP = 1024, 11, 1 << 21, 4096
_BITS = np.uint64(21)
_tables: dict = {}


def letters() -> np.ndarray:
    """The lower-case code point of every code point that is a letter, else 0."""
    if "letters" not in _tables:
        out = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of some texts (21 bits a letter) and the row that each is from, in order."""
    sym = letters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")]
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]  # of each row, in code points
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    edge = np.ones(len(sym), bool)
    edge[1:] = row[1:] != row[:-1]
    run = np.zeros(len(sym), bool)
    run[1:] = (sym[1:] == 0) & (sym[:-1] == 0) & ~edge[1:]
    sym, row = sym[~run].astype(np.uint64), row[~run]
    if len(sym) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    t = (((sym[:-2] << _BITS) | sym[1:-1]) << _BITS) | sym[2:]
    own = (row[:-2] == row[2:]) & (t > 0)
    return t[own], row[:-2][own]


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before and after each, so that a word of one letter has a trigram."""
    n = len(off) - 1
    out = np.full(len(data) + 2 * n, 0x20, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    out[at] = data
    return out, off + 2 * np.arange(n + 1)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """+1 and -1 by the hashed bits of each code point."""
    words = mix(mix(codes.astype(np.uint64) + np.uint64(SEED << 32))[:, None] + np.arange(DIMENSIONS // 64, dtype=np.uint64))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(codes), -1), axis=1)
    return 1 - 2 * bits.astype(np.float32)


def vectors(t: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: bound, permuted letter vectors."""
    low = np.uint64((1 << 21) - 1)
    used, place = np.unique(np.stack([t >> (_BITS + _BITS), (t >> _BITS) & low, t & low]), return_inverse=True)
    v, (i, j, k) = letter_vectors(used), place.reshape(3, -1)
    return np.roll(v, 2, 1)[i] * np.roll(v, 1, 1)[j] * v[k]


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds))


def bundles(rows: DataFrame) -> DataFrame:
    """lang, dimension, n: the sum of all texts' vectors by language; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, off in parts(batch):
                t, row = trigrams(*padded(data, off))
                names = sorted(set(langs[a:b]))
                which = np.array([names.index(x) for x in langs[a:b]])[row]
                for k, name in enumerate(names):
                    own, n = np.unique(t[which == k], return_counts=True)
                    total = sums.setdefault(name, np.zeros(DIMENSIONS, np.int64))
                    for i in range(0, len(own), STEP):
                        total += (n[i : i + STEP].astype(np.float64) @ vectors(own[i : i + STEP])).astype(np.int64)
        for name, n in sums.items():
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(n)], ["lang", "dimension", "n"])

    made = map_batches(rows.select("lang", "text"), run, "lang string, dimension int, n long")
    return made.groupBy("lang", "dimension").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, held: int = 2, folds: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, of length 1."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    found = bundles(labelled).toArrow()
    lang = found["lang"].to_pylist()
    names = sorted(set(lang))
    out = np.zeros((len(names), DIMENSIONS), np.float64)
    out[[names.index(x) for x in lang], found["dimension"].to_numpy()] = found["n"].to_numpy()
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def bundled(t: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The sum of each of n rows' trigram vectors, with at most CELLS counts at once."""
    seen, place = np.unique(t, return_inverse=True)
    if n > 1 and n * len(seen) > CELLS:
        half = n // 2
        at = int(np.searchsorted(row, half))
        return np.concatenate([bundled(t[:at], row[:at], half), bundled(t[at:], row[at:] - half, n - half)])
    out = np.zeros((n, DIMENSIONS), np.float32)
    if len(seen):
        bag = np.bincount(row * len(seen) + place, minlength=n * len(seen)).reshape(n, -1).astype(np.float32)
        for a in range(0, len(seen), STEP):
            out += bag[:, a : a + STEP] @ vectors(seen[a : a + STEP])
    return out


def cosines(data: np.ndarray, off: np.ndarray, prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each text with each prototype, and whether the text has a letter."""
    t, row = trigrams(*padded(data, off))
    n = len(off) - 1
    held = bundled(t, row, n)
    size = np.linalg.norm(held, axis=1, keepdims=True)
    return held @ prototypes.T / np.maximum(size, 1e-12), np.bincount(row, minlength=n) > 0


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred and score (the cosine, at least 0) of every text."""
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, _, data, off in parts(batch):
                if names:
                    c, letters = cosines(data, off, shared.value)
                    k = c.argmax(1)
                    best += [names[x] if y else "und" for x, y in zip(k, letters, strict=True)]
                    score += np.where(letters, np.clip(c[np.arange(len(k)), k], 0, 1), 0).astype(float).tolist()
                else:
                    best += ["und"] * (len(off) - 1)
                    score += [0.0] * (len(off) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"{id_col} {kind}, lang_pred string, score double")


def op6(docs: DataFrame) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
