"""Hash links, tampering, sources and signatures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical, ed25519, times
from tidemark.operators import heads, ledger
from tidemark.sources import files, schemas

AT = "2026-10-0{}T00:00:0{}.000Z"


def chain(n=12):
    """Rows of a right ledger, each as JSON with its keys in order."""
    out, before = [], ledger.GENESIS
    for k in range(n):
        row = {"event": "correction", "format_version": 1, "prev_hash": before, "recorded_at": AT.format(1 + k // 6, k % 6), "reason": f"r\u001f\"{k}é/", "seq": k, "corrects_seq": 0}
        row = dict(sorted(row.items()))
        text = json.dumps(row, ensure_ascii=False, separators=(",", ":"))
        before = row["entry_hash"] = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        out.append(row)
    return out


def load(spark, rows):
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "line string")
    return lines.select(F.from_json("line", schemas.ENTRY).alias("r")).select("r.*")


def test_right_ledger_verifies(spark):
    v = ledger.verdict(load(spark, chain())).first()
    assert v.valid and v.entries == 12 and v.first_seq == 0 and v.last_seq == 11


def test_linked_rows_verify(spark):
    """link() makes the hashes of a ledger written by hand, in one append or two, and violations() finds none."""
    want = [(r["seq"], r["prev_hash"], r["entry_hash"]) for r in chain()]
    rows = load(spark, chain()).withColumns({c: F.lit(None).cast("string") for c in ("prev_hash", "entry_hash")})
    first = ledger.link(rows.where("seq < 7"), ["recorded_at"])
    last = first.orderBy(F.desc("seq")).first()
    both = first.unionByName(ledger.link(rows.where("seq >= 7"), ["recorded_at"], (last.seq, last.entry_hash)))
    assert [tuple(r) for r in both.select("seq", "prev_hash", "entry_hash").orderBy("seq").collect()] == want
    assert ledger.violations(both).count() == 0
    bad = ledger.violations(both.withColumn("reason", F.when(F.col("seq") == 3, "x").otherwise(F.col("reason")))).collect()
    assert [(r.seq, r.what) for r in bad] == [(3, "hash mismatch")]


def test_hashes_go_back_without_the_driver(spark):
    """However small Spark takes them for, the hashes of an append are not broadcast."""
    rows = spark.createDataFrame([(f"t{k % 7}", k) for k in range(50)], "recorded_at string, reason long")
    linked = ledger.link(rows, ["recorded_at", "reason"], (9, ledger.GENESIS))
    plan = linked._jdf.queryExecution().toString()
    assert "SortMergeJoin [seq" in plan and plan.count("BroadcastHashJoin [_part") and "BroadcastHashJoin [seq" not in plan
    got = linked.orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(10, 60)) and [(r.recorded_at, r.reason) for r in got] == sorted((f"t{k % 7}", k) for k in range(50))
    assert all(a.entry_hash == b.prev_hash for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("part", [3, 1 << 20])
def test_row_before_crosses_parts(spark, part):
    rows = spark.createDataFrame([(x, f"v{x}") for x in (0, 1, 2, 7, 8, 20, 21)], "seq long, v string")
    got = {r.seq: r.prev_v for r in ledger.with_row_before(rows, "seq", ["v"], part).collect()}
    assert got == {0: None, 1: "v0", 2: "v1", 7: "v2", 8: "v7", 20: "v8", 21: "v20"}


@pytest.mark.parametrize(
    ("change", "seq", "what"),
    [
        (lambda r: r[5].update(reason="x"), 5, "hash mismatch"),
        (lambda r: r.pop(7), 8, "sequence gap at seq 7"),
        (lambda r: r[4].update(prev_hash=ledger.GENESIS), 4, "hash mismatch"),
        (lambda r: r[0].update(format_version=2), 0, "format version"),
        (lambda r: r.pop(0), None, None),  # a range may start anywhere
    ],
)
def test_tampering_names_the_first_bad_row(spark, change, seq, what):
    rows = chain()
    change(rows)
    v = ledger.verdict(load(spark, rows)).first()
    assert (v.bad_seq, v.failure) == (seq, what)


DIGEST = {"date": "2026-10-01", "failed": 0, "files": [{"path": "a", "sha256": "x"}, {"path": "b", "sha256": "y"}], "not_modified": 0, "ok": 1, "repos_polled": 1, "skipped": 0}
BOUND = {"commit_sha": "c", "first_observed": "2026-10-01T00:00:00.000Z", "last_observed": "2026-10-03T23:00:00.000Z", "observation_count": 2, "stable_days": 2}
RIGHT = {
    "observation_digest": {"observation_digest": DIGEST},
    "population_change": {"repo": "o/r", "population_change": {"change": "added", "reason": {"type": "transitive", "via": "o/p@c"}}},
    "correction": {"corrects_seq": 0, "reason": "r"},
    "correlation": {"correlation": {"all_to_same_target": True, "batch_id": "b", "member_seqs": [1], "refs_moved_together": ["x"]}},
    "move": {"classification": "content_change", "severity": "high", "observation_window_seconds": 5, "source_observations": ["x", "y"], "from": BOUND, "to": {**BOUND, "last_observed": None, "stable_days": 0}},
}


CASES = [
    *((event, {}, []) for event in RIGHT),
    ("observation_digest", {"observation_digest": None}, ["digest missing", "digest date not of 10 characters"]),
    ("observation_digest", {"observation_digest": {**DIGEST, "files": DIGEST["files"][::-1]}}, ["digest files out of order"]),
    ("observation_digest", {"observation_digest": {**DIGEST, "date": "2026-10-1"}}, ["digest date not of 10 characters"]),
    ("population_change", {"repo": None}, ["population change without repository or payload"]),
    ("population_change", {"population_change": None}, ["population change without repository or payload"]),
    ("population_change", {"population_change": {"change": "added", "reason": {"type": "transitive", "via": "o/p"}}}, ["transitive reason without a source at a commit"]),
    ("correction", {"diff": {"files_added": 1}}, ["correction with diff"]),
    ("correlation", {"correlation": {"batch_id": "", "member_seqs": [1]}}, ["correlation without batch"]),
    ("correlation", {"correlation": {"batch_id": "b", "member_seqs": [99]}}, ["correlation member not before its row"]),
    ("move", {"from": {**BOUND, "stable_days": 3}}, ["stable days not those of the binding"]),
    ("move", {"from": None}, ["binding missing"]),
]


def test_rules_of_events_hold_in_the_ledger(spark):
    rows = [{"event": e, "format_version": 1, "prev_hash": "sha256:x", "recorded_at": AT.format(1, 1), "seq": 9 + k, **RIGHT[e], **change} for k, (e, change, _) in enumerate(CASES)]
    loaded = load(spark, rows)
    want = {9 + k: names for k, (_, _, names) in enumerate(CASES)}
    assert {r.seq: r.problems for r in ledger.problems(loaded, ledger.ledger_problems()).select("seq", "problems").collect()} == want
    found = [(r.seq, r.what) for r in ledger.violations(loaded).collect() if r.what not in ("hash mismatch", "broken link")]
    assert sorted(found) == sorted((k, x) for k, names in want.items() for x in names)


def test_limited_poll_needs_its_limit_event(spark):
    lines = [json.dumps({"outcome": {"type": t, "http_status": n}, "secondary_limit_observed": s}) for t, n, s in (("failed", 403, None), ("failed", 429, {"status": 429}), ("failed", 500, None), ("ok", 200, None))]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(F.from_json("line", schemas.OBSERVATION).alias("r")).select("r.*")
    assert [r.problems for r in ledger.problems(rows, ledger.observation_problems()).collect()] == [["limit event missing"], [], [], []]


def test_day_files_round_trip(spark, tmp_path):
    for r in chain():
        p = tmp_path / r["recorded_at"][:10].replace("-", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{p}.jsonl", "a") as f:
            f.write(json.dumps(r, ensure_ascii=False) + "\n\n")
    (tmp_path / "heads.jsonl").write_text("{}\n")
    (tmp_path / "2026/10/01.torn").write_text("x")
    read = files.ledger(spark, str(tmp_path))
    assert ledger.verdict(read).first().valid
    assert files.ignored(spark, str(tmp_path)).count() == 2
    files.write_ledger(read, str(tmp_path / "out"))
    again = files.ledger(spark, str(tmp_path / "out"))
    assert again.count() == read.count() and ledger.verdict(again).first().valid
    (tmp_path / "2026/10/02.jsonl").write_text('{"seq": 1, "ev')
    with pytest.raises(Exception, match="corrupt line in"):
        files.ledger(spark, str(tmp_path)).count()


def test_quarantine_and_closed_schema(spark, tmp_path):
    p = tmp_path / "2026/10"
    p.mkdir(parents=True)
    (p / "01.jsonl").write_text('{"seq": 0}\n{"seq": 1, "extra": 2}\n{"seq": 2, "ev')
    good, bad = files.parsed(files.lines(spark, str(tmp_path), files.DAY_FILE), schemas.ENTRY)
    assert good.count() == 2 and bad.count() == 1
    assert [(r.seq, r.unknown) for r in files.closed(good, schemas.ENTRY).collect()] == [(1, ["extra"])]


def test_journal_keeps_the_last_record(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("\n".join(json.dumps({"sha": s, "tree_sha": t}) for s, t in (("a", "1"), ("b", "2"), ("a", "3"))) + "\n")
    got = files.journal(spark, str(tmp_path / "j.jsonl"), schemas.OBJECT, ["sha"])
    assert {r.sha: r.tree_sha for r in got.collect()} == {"a": "3", "b": "2"}


def test_journal_in_many_splits(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("".join(json.dumps({"sha": f"s{k * k % 97}", "tree_sha": str(k)}) + "\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.journal(spark, str(tmp_path / "j.jsonl"), schemas.OBJECT, ["sha"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.sha: r.tree_sha for r in got} == {f"s{k * k % 97}": str(k) for k in range(3000)}


def test_canonical_text_has_lower_escapes_and_sorted_keys(spark):
    df = spark.createDataFrame([("\u001f\\u001F", 1, None, [])], "b string, a int, c string, d array<int>")
    assert df.select(canonical.canonical_json(df, df.columns)).first()[0] == '{"a":1,"b":"\\u001f\\\\u001F","d":[]}'


def test_strict_times(spark):
    rows = spark.createDataFrame([("2026-10-01T00:00:00.123Z",), ("2026-10-01T00:00:00.1234Z",), ("2026-10-01T00:00:00.123+00:00",), ("2026-13-01T00:00:00.123Z",), (None,)], "s string")
    assert [r[0] is not None for r in rows.select(times.strict(F.col("s"))).collect()] == [True, False, False, False, False]


def test_signatures_by_the_published_vectors(spark):
    # RFC 8032, section 7.1, tests 1 and 2, and 7.3
    for seed, key, message, signature in [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]:
        s, k, m, sig = (bytes.fromhex(x) for x in (seed, key, message, signature))
        assert ed25519.public_key(s) == k and ed25519.sign(s, m) == sig and ed25519.verify(k, m, sig)
        assert not ed25519.verify(k, m + b"x", sig)
    s, m = bytes.fromhex("833fe62409237b9d62ec77587520911e9a759cec1d19755b7da901b96dca3d42"), b"abc"
    sig = ed25519.sign(s, m, prehashed=True)
    assert sig.hex().startswith("98a70222f0b8121aa9d30f813d683f80") and ed25519.verify(ed25519.public_key(s), m, sig, prehashed=True)


def test_heads(spark):
    rows = chain(4)
    seed = bytes(range(32))
    key = ed25519.public_key(seed).hex()
    lines = []
    for k, hash_ in ((2, None), (3, "sha256:" + "1" * 64), (9, None)):
        head = {"entry_hash": hash_ or (rows[k]["entry_hash"] if k < 4 else ledger.GENESIS), "log_id": "log", "recorded_at": AT.format(1, 5), "seq": k}
        text = json.dumps(head, separators=(",", ":"))
        lines.append((json.dumps({"head": head, "key_id": hashlib.sha256(bytes.fromhex(key)).hexdigest(), "public_key": key, "signature": ed25519.sign(seed, text.encode()).hex()}),))
    h = spark.createDataFrame(lines, "line string").select(F.from_json("line", schemas.HEAD).alias("r")).select("r.*")
    led = load(spark, rows)
    assert {(r.seq, r.what) for r in heads.failures(h, led).collect()} == {(3, "another hash"), (9, "no such row")}
    bad = h.where("head.seq = 2").withColumn("signature", F.concat(F.lit("00"), F.substring("signature", 3, 200)))
    assert [(r.seq, r.what) for r in heads.failures(bad, led).collect()] == [(2, "bad signature")]
    assert heads.two_faced(h.unionByName(bad)).first().seq == 2
