"""URL rules, token alignment and importance resampling against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tests.conftest import SMALL
from tests.llm.test_operators import frame, odd_texts
from tidemark.llm import alignment, importance, queries, url_rules


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# URL rules

URLS = [
    None, "", "no scheme", "://", "http://ORG/", "http://org", "http://a.org/x", "http://notorg/x", "https://Example.ORG/es/1?x=1#y", "http://m.example.org/es", "http://m.example.org/en/123", "http://m.example.org/en/2",
    "http://x.com/fr/1://y.org/", "http://x.com/de/#/fr/", "http://x.com?/de/", "http://é.com/DE/", "ftp://u:p@x.com:80/de/a b", "http://x.net/de/1", "http://x.net/es/7", "http:///es/", "http://.org/", "x://y://z.org/", "http://x.com/de/" + "s/" * 3000,
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", 1.0, "t") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, confidence double, tokens string")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate({k: k + 32 for k in range(65, 91)}), re.split("[?#]", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_hosts_paths_and_listed_rules(spark):
    got = {r.page_id: r for r in url_rules.verdicts(pages(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), u
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")
    assert got[0].verdict == got[1].verdict == got[2].verdict == "allow"


def plain_mined(labelled):
    """Rules by counting all combinations, from (tokens, verdict)."""
    total = collections.Counter(v for _, v in labelled)
    seen = {v: collections.Counter(t for ts, w in labelled if w == v for t in set(ts)) for v in ("block", "allow")}
    least = math.ceil(url_rules.SUPPORT * len(labelled))
    weight = {t: abs(seen["block"][t] / total["block"] - seen["allow"][t] / total["allow"]) for t in seen["block"] | seen["allow"] if seen["block"][t] + seen["allow"][t] >= least}
    held = {v: collections.Counter() for v in total}
    for ts, v in labelled:
        best = sorted((t for t in set(ts) if t in weight), key=lambda t: (-weight[t], t))[: url_rules.MINED]
        for n in range(1, url_rules.MOST_TOKENS + 1):
            held[v].update(itertools.combinations(sorted(best), n))
    rules = {}
    for v in held:
        for items, n in held[v].items():
            sure = n / sum(held[w][items] for w in held)
            if n >= least and sure >= url_rules.CONFIDENCE:
                rules[items, v] = (sure, n)
    spare = {(i, v) for (i, v), (sure, _) in rules.items() for k in range(1, len(i)) for part in itertools.combinations(i, k) if rules.get((part, v), (0,))[0] >= sure}
    return {k: x for k, x in rules.items() if k not in spare}


@pytest.mark.parametrize("seed", range(2))
def test_mined_rules_equal_counting_all_combinations(spark, seed):
    rng = random.Random(seed)
    rows = [([t for t in "abcdefghijkl" if rng.random() < 0.5], rng.choice(["block", "allow", "allow"])) for _ in range(150)]
    rows += [(["a", "k", "z"], "block")] * 30 + [(["b", "y"], "allow")] * 70 + [([], "allow"), (["z"], "allow")]
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.n) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert got == plain_mined(rows) and len(got) > 3


@pytest.mark.parametrize("seed", range(2))
def test_rules_of_all_tokens_equal_counting_all_combinations(spark, monkeypatch, seed):
    rng = random.Random(seed)
    long = [f"t{k:02}" for k in range(40)]  # 2**40 combinations for FP-growth
    rows = [(sorted(rng.sample("abcdefghijklmnop", 12)), rng.choice(["block", "allow", "allow"])) for _ in range(100)]
    rows += [([*long, "z"], "block")] * 20 + [(long[:10], "allow")] * 10 + [([], "allow"), (["y", "z"], "allow")]
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.n) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), mined=None).collect()}
    least = plain_mined(rows)
    monkeypatch.setattr(url_rules, "MINED", None)
    want = plain_mined(rows)
    assert got == want and len(got) > len(least)


def test_verdicts_by_all_tokens_equal_the_sql_without_its_cut(spark, duck, monkeypatch):
    got = url_rules.verdicts(spark.read.parquet(f"{SMALL}/pages.parquet"), mined=None)
    cut = sorted(duck.sql(url_rules.oracle_sql()).fetchall(), key=repr)
    monkeypatch.setattr(url_rules, "MINED", 1 << 30)
    want = sorted(duck.sql(url_rules.oracle_sql()).fetchall(), key=repr)
    assert rows_of(got) == want != cut


def test_verdicts_leave_no_token_out_unless_told_and_the_query_is_as_its_sql(spark, duck, monkeypatch):
    assert rows_of(queries.op11_url_rules(spark, SMALL)) == sorted(duck.sql(url_rules.oracle_sql()).fetchall(), key=repr)
    monkeypatch.setattr(url_rules, "MINED", 1 << 30)
    assert rows_of(url_rules.verdicts(spark.read.parquet(f"{SMALL}/pages.parquet"))) == sorted(duck.sql(url_rules.oracle_sql()).fetchall(), key=repr)


def test_rules_match_by_all_their_tokens(spark):
    rules = spark.createDataFrame([(["a", "b"], "block", 0.9, 5), (["c"], "allow", 0.9, 7), (["b"], "block", 0.85, 9), (["a", "c", "d"], "block", 1.0, 2)], "tokens array<string>, verdict string, confidence double, n long")
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],), (["a", "b", "c"],), (["a", "c", "d"],), ([],), (["x"],)], "tokens array<string>")
    assert {("".join(r[0]), r[1]) for r in url_rules.matched(sets, rules).collect()} == {("b", "block"), ("ab", "block"), ("abc", "allow"), ("acd", "block")}


def test_urls_without_labels_of_both_verdicts_or_rows(spark):
    got = url_rules.verdicts(pages(spark, ["http://a.org/x", "http://a.net/x", "http://a.net/x"])).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    assert url_rules.verdicts(pages(spark, URLS).limit(0)).count() == 0


def test_url_rules_run_no_python_worker(spark):
    plan = queries.op11_url_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# alignment


def tokenizers_of_the_contract():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of_sign():
    """The byte that each sign of a byte-level entry stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(texts):
    a_of, b_of = tokenizers_of_the_contract()
    signs, found, count = byte_of_sign(), [], collections.Counter()
    for t in texts:
        a = [(i, bytes(signs[c] for c in a_of.id_to_token(i))) for i in a_of.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode()) for i in (b_of.encode(t) if t else []) for p in [b_of.id_to_piece(i)]]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append(None)
            continue
        ends = []
        for side in (a, b):
            at = list(itertools.accumulate(len(x) for _, x in side))
            ends.append([(i, e - len(x), e) for (i, x), e in zip(side, at, strict=True)])
        cuts = sorted({e for _, _, e in ends[0]} & {e for _, _, e in ends[1]})
        groups, links, start = [], [], 0
        for c in cuts:
            ga, gb = ([x for x in side if start < x[2] <= c] for side in ends)
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if max(x[1], y[1]) < min(x[2], y[2])]
            start = c
        count.update(links)
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for f in found]


ALIGNED = ["a  b", " a", "a ", "a\n b\t c", "ﬁ é é Ａ", "<s> x </s> <0x41> <|endoftext|> y", "▁x", "ok ▁ no", " ", "   ", "\x00a", "日本 語 日本語テキスト", "\xa0x \u2003 y", "it's we'll DON'T", "😀 👩‍👩‍👧 x", "\r\n", "tab\tin word", "a\x1c b \x1dc", "one\ntwo\nthree\n\nfour \nfive\n six", "\nx\ny", "\x00\nx y \x00z", "\x00x \x00y\n\x00z\n", "a\r\nb\nc \x00"]


def test_alignment_equals_brute_force(spark):
    texts = odd_texts() + ALIGNED + ["unbroken" * 4000, "word " * 20000, ALIGNED[0]]
    for block, most, hot in ((1, 1, 1), (alignment.BLOCK, alignment.PAIRS, 50)):
        got = sorted(tuple(r) for r in alignment.op12(frame(spark, texts), block=block, most=most, hot=hot).collect())
        assert got == [(i, *x) for i, x in enumerate(plain_alignment(texts))]


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_links_of_long_groups_by_cells(spark, cell):
    rng = random.Random(5)

    def side(n):
        ends = sorted(rng.sample(range(1, 900), n)) + [900]
        return [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]

    a, b = side(60), side(90)
    token = "array<struct<id:int,start:long,end:long>>"
    groups = spark.createDataFrame([("s", 5, 0, a, b), ("s", 5, 1, a[:1], b[:2]), ("t", 6, 0, b, a)], f"stretch string, n long, grp long, a {token}, b {token}")
    want = [(u, n, x[0], y[0]) for u, n, p, q in (("s", 5, a, b), ("s", 5, a[:1], b[:2]), ("t", 6, b, a)) for x in p for y in q if max(x[1], y[1]) < min(x[2], y[2])]
    assert rows_of(alignment.links_by_cells(groups, cell)) == sorted(want, key=repr)
    within = groups.select("stretch", "n", F.explode(alignment.links_within(F.col("a"), F.col("b"))).alias("l")).select("stretch", "n", "l.a", "l.b")
    assert rows_of(within) == sorted(want, key=repr)


def test_alignment_leaves_only_what_comes_back_to_the_blocks(spark):
    at = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")) / "tidemark"
    old = {x.name for x in at.glob("*")}
    got = alignment.op12(frame(spark, ["one two one", "two two\nthree", None, "one  x"]))
    assert {x.name.rsplit("-", 1)[0] for x in at.glob("*") if x.name not in old} == {"numbers", "pair-counts", "best-pairs", "summed"}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # of links or stretches
    assert len(got.collect()) == 4 and len(got.collect()) == 4


def test_numbers_of_stretches_are_packed():
    for ks in ([], [0], [7, 1 << 30, 255, 256, 7], list(range(5000))):
        assert alignment.unpacked(alignment.packed(np.array(ks, np.int32))).tolist() == ks
    assert len(alignment.packed(np.arange(100_000, dtype=np.int32))) < 100_000


def test_groups_are_packed_in_half_their_bytes(spark):
    texts = ["1|2", "10,2|3;4|5,66", "0|0;50256|31999", "7,7|7"]
    rows = spark.createDataFrame([(k, t.translate(str.maketrans(",|;", "abc"))) for k, t in enumerate(texts)], "k int, t string")
    got = [bytes(r[0]) for r in rows.orderBy("k").select(alignment.packed_text(F.col("t"))).collect()]
    assert [len(x) for x in got] == [(len(t) + 1) // 2 for t in texts]
    assert alignment.digest(x.hex() for x in got) == hashlib.sha256(";".join(texts).encode()).hexdigest()


def traced(work):
    """What it returns, and the bytes that Python and numpy held at most meanwhile."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_holds_its_different_stretches_but_no_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "map_batches", lambda df, run, schema: run)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    run = alignment.blocks(frame(spark, ["a"]))
    alignment.pair()
    rng = random.Random(7)
    texts = [[" ".join(rng.choices(["one", "two", "three", "▁"], [9, 9, 9, 0.001], k=20_000)) for _ in range(10)] for _ in range(10)]
    batches = [pa.record_batch([pa.array(range(10 * k, 10 * k + 10)), pa.array(t)], ["doc_id", "text"]) for k, t in enumerate(texts)]
    got, most = traced(lambda: pa.Table.from_batches(list(run(iter(batches)))).to_pylist())
    assert most < sum(len(t) for ts in texts for t in ts) / 2
    names = {r["k"]: (r["stretch"], r["n"]) for r in got if r["stretch"]}
    read = {r["doc_id"]: r["ks"] and " ".join(names[k][0] for k in alignment.unpacked(r["ks"])) for r in got if not r["stretch"]}
    assert read == {10 * k + i: None if "▁" in t else t for k, ts in enumerate(texts) for i, t in enumerate(ts)}
    valid = collections.Counter(w for t in read.values() if t for w in t.split())
    assert {x: n for x, n in names.values() if n} == valid and {r["block"] for r in got} == {3 << 32}


def test_the_last_step_holds_no_object_for_each_stretch():
    class Docs(SimpleNamespace):
        schema = StructType([StructField("doc_id", LongType())])
        groupBy = cogroup = lambda self, *_: self
        applyInArrow = lambda self, run, schema: run

    run, n, rng = alignment.by_document(Docs(), Docs()), 200_000, np.random.default_rng(3)
    ids = rng.integers(0, 50_000, (n, 3)).tolist()
    groups = [f"{a}|{b}" if a % 2 else f"{a},{c}|{b};{c}|{a}" for a, b, c in ids]
    hexed = [x + "d" * (len(x) % 2) for x in (g.translate(str.maketrans(",|;", "abc")) + "c" for g in groups)]
    k = rng.permutation(n)
    right = pa.table([np.zeros(n, np.int64), k.astype(np.int32), np.full(n, 2, np.int32), k % 5, k % 7, pa.array([bytes.fromhex(hexed[x]) for x in k])], ["_block", "k", "n_a", "n_best", "count_sum", "groups"])
    ks = [np.arange(n), None, np.array([5]), rng.integers(0, n, 150_000)]
    left = pa.table([[0] * 4, range(4), [None if x is None else alignment.packed(x) for x in ks]], ["block", "doc_id", "ks"])
    got, most = traced(lambda: run(left, right).to_pylist())
    assert most < 80 * n
    for r, x in zip(got, ks, strict=True):
        text = "" if x is None else ";".join(groups[i] for i in x)
        p, q = text.count("|"), text.count(",")
        sums = (0, 0) if x is None else (int((x % 5).sum()), int((x % 7).sum()))
        n_a = 0 if x is None else 2 * len(x)
        assert tuple(r.values())[1:] == (n_a, q + 2 * p - n_a, p, q + p, *sums, hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_alignment_of_repeated_and_null_ids_and_of_nothing(spark):
    docs = frame(spark, ["the same text"] * 3 + ["other"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, 7))
    got = alignment.op12(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "7", "7", "None"]
    want = plain_alignment(["the same text"] * 3 + ["other"])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert alignment.op12(docs.limit(0)).count() == 0


# importance


def plain_scores(docs, target, most=1, buckets=importance.BUCKETS):
    """docs: (doc_id, text)."""
    low = {k: k + 32 for k in range(65, 91)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    words = [split(t) for _, t in docs]
    feats = [runs(w) for w in words]
    s = collections.Counter(place(f) for fs in feats for f in fs)
    t = collections.Counter(place(f) for x in target for f in runs(split(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _), w, fs in zip(docs, words, feats, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(best[: 10 * len(best) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_resampling_equals_brute_force(spark, most):
    texts = [*odd_texts(3, 150), "Größe ÉÉ 12a_b-c", "x" * 70000, "It's " * 500]
    target = ["abc aé12", None, "", texts[9], "it s"]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for hot in (1, 1 << 17):
        got = rows_of(importance.resample(docs, bench, most=most, hot=hot))
        assert got == plain_scores(list(enumerate(texts)), target, most)
        if most > 1:
            break


def test_resampling_with_repeated_and_null_ids_ties_and_nothing(spark):
    texts = [" ".join(f"w{k % 7}" for k in range(30))] * 50
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 6))
    bench = spark.createDataFrame([("w1 w2",)], "text string")
    got = importance.resample(docs, bench).collect()
    assert len(got) == 50 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], ["w1 w2"])
    assert sorted((repr(r.doc_id), r.weight, r.score) for r in got) == sorted((repr(r[0]), *r[2:4]) for r in want)
    assert importance.resample(docs.limit(0), bench).count() == 0
    none = importance.resample(docs, bench.limit(0)).collect()
    assert sorted(r.weight for r in none) == sorted(r[2] for r in plain_scores([(r.doc_id, r.text) for r in docs.collect()], []))


def test_ranks_are_gapless_over_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
        got = importance.ranked(rows, [F.col("v").desc(), F.col("id").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r["_rank"] for r in sorted(got, key=lambda r: (-r.v, r.id))] == list(range(1, 5001))
