"""The pipeline's stages, each against brute force over what the stage before kept."""

import collections
import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.test_operators import lower
from tidemark.llm import mixing, toxicity
from tidemark.llm.storage import stage, table


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, duck):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs = [table(spark, SMALL, "documents")]
    for name, f in corpus_pipeline.STAGES:
        docs.append(stage(f(spark, docs[-1], SMALL), "test"))
    raw, clean, exact, near, mixed, packed = docs
    assert raw.columns == clean.columns == exact.columns == near.columns == mixed.columns

    labels = table(spark, SMALL, "labels")
    kept = {r.doc_id for r in toxicity.op7(raw, labels).where("score < 0.7").collect()}
    assert set(texts(clean)) == kept

    groups = collections.defaultdict(list)
    for i, t in texts(clean).items():
        groups[hashlib.sha256(lower(t)).digest()].append(i)
    assert set(texts(exact)) == {max(g) for g in groups.values()}

    sets = {}
    for i, t in texts(exact).items():
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(a):
        return a if up[a] == a else find(up[a])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert set(texts(near)) == {i for i in sets if find(i) == i}

    duck.register("kept_documents", near.toPandas())
    want = collections.Counter()
    for i, size, taken in duck.sql(f"SELECT doc_id, size, taken FROM ({mixing.oracle_sql('kept_documents')})").fetchall():
        want[i] = taken // size if size else 0
    assert collections.Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +want

    rows = packed.collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == +want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_stages_with_clashing_names_odd_rows_and_long_texts(spark):
    """Rows keep their own columns whatever these are called; null ids and texts, empty and long ones pass."""
    names = ["_key", "_p", "_likely", "_bucket", "_bit", "_score", "_row", "_n", "_stay", "_copy", "row", "score"]
    long = " ".join(f"w{k % 5003}x{k % 7919}" for k in range(400_000))
    rows = [(1, long), (2, long), (3, None), (4, ""), (None, "a b c d e f g"), (5, "one two three"), (6, "one two three"), (6, "one two three")]
    docs = spark.createDataFrame([(i, "s", "en", t) for i, t in rows], "doc_id long, source string, lang string, text string")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, f in corpus_pipeline.STAGES[:-1]:
            now = stage(f(spark, now, SMALL), "clash")
            assert sorted(now.columns) == sorted(docs.columns), name
            for r in now.drop("text").collect():
                assert all(r[n] == n + ("none" if r.doc_id is None else str(r.doc_id)) for n in names), name
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert ids <= {None, 2, 4, 5, 6} and (not empty or not ids)
        assert corpus_pipeline.pack(spark, now, SMALL).count() >= len(ids)


def test_one_of_many_equal_rows_stays(spark):
    rows = spark.range(3000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit("the same row").alias("text"))
    rows = rows.unionByName(rows.limit(2).withColumn("doc_id", F.lit(8).cast("long"))).unionByName(rows.limit(1).withColumns({"doc_id": F.lit(1).cast("long"), "text": F.lit("another")}))
    kept = corpus_pipeline.drop_copies(spark, rows, SMALL)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 9]
