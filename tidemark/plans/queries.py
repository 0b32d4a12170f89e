"""The engine's queries, each a thin use of its operators, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import canonical, refs, times
from tidemark.operators import bindings, classify, entries, ledger, listings, objects, population, score, verify
from tidemark.plans.adapters import DAY, HOUR, OBS_SQL, inline, observations, table, values_sql
from tidemark.sources import published, schemas, shared
from tidemark.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


NAMES = ["v1", "V1", "1", "v01", "v1.2", "v1.02", "v1.2.3", "1.2.3", "v1.2.3.4", "v1.2.3-rc.1", "v1.2.3-", "v1.2.3+b", "v1.2.3-rc.1+b", "v1.2+x", "v1+x", "main", "Latest", "stable", "refs/tags/v2", "refs/tags/v2.1.0", "refs/heads/main", "", "v", "v1.", "2024.01.15", "v0", "v0.0.0", "release-1", "v1.2-rc", "v10.20.30-a-b"]
N = "(0|[1-9][0-9]*)"
FORM_SQL = f"""CASE
  WHEN lower(b) IN ('main', 'latest', 'stable') THEN 'named_channel'
  WHEN contains(b, '+') AND regexp_matches(split_part(b, '+', 1), '^v?{N}\\.{N}\\.{N}$') THEN 'exact'
  WHEN contains(b, '+') AND regexp_matches(split_part(b, '+', 1), '^v?{N}\\.{N}$') THEN 'floating_minor'
  WHEN contains(b, '+') THEN 'other'
  WHEN regexp_matches(b, '^v?{N}\\.{N}\\.{N}-.+$') THEN 'exact'
  WHEN regexp_matches(b, '^v?{N}$') THEN 'floating_major'
  WHEN regexp_matches(b, '^v?{N}\\.{N}$') THEN 'floating_minor'
  WHEN regexp_matches(b, '^v?{N}\\.{N}\\.{N}$') THEN 'exact' ELSE 'other' END"""


@query(f"SELECT name, form, form IN ('named_channel', 'floating_major', 'floating_minor') AS floating FROM (SELECT name, {FORM_SQL} AS form FROM (SELECT name, regexp_replace(name, '^refs/tags/', '') AS b FROM ({values_sql([(n,) for n in NAMES])}) t(name)))")
def q01_ref_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inline(spark, [(n,) for n in NAMES], "name string")
    return names.select("name", refs.ref_form(F.col("name")).alias("form")).withColumn("floating", refs.is_floating(F.col("form")))


FORMS = ["named_channel", "floating_major", "floating_minor", "exact", "other"]
KINDS = ["release_level_only", "commit_metadata_only", "content_change"]
ANCESTRIES = ["ahead", "behind", "diverged", "identical", None]
SEVERITY_SQL = """CASE WHEN correlated THEN 'high' WHEN kind = 'release_level_only' THEN 'info'
  WHEN kind = 'commit_metadata_only' THEN CASE WHEN form = 'exact' THEN 'medium' WHEN form IN ('floating_major', 'floating_minor') THEN 'low' ELSE 'info' END
  WHEN form = 'exact' THEN 'high'
  WHEN form IN ('floating_major', 'floating_minor') THEN CASE WHEN ancestry IN ('behind', 'diverged') THEN 'high' ELSE 'low' END
  ELSE 'info' END"""


@query(f"""SELECT form, kind, ancestry, correlated, {SEVERITY_SQL} AS severity
FROM ({values_sql([(x,) for x in FORMS])}) f(form), ({values_sql([(x,) for x in KINDS])}) k(kind), ({values_sql([(x,) for x in ANCESTRIES])}) a(ancestry), (VALUES (true), (false)) c(correlated)""")
def q02_severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = inline(spark, [(FORMS, KINDS, ANCESTRIES, [True, False])], "f array<string>, k array<string>, a array<string>, c array<boolean>")
    for source, name in (("f", "form"), ("k", "kind"), ("a", "ancestry"), ("c", "correlated")):
        every = every.withColumn(name, F.explode(source))
    return every.select("form", "kind", "ancestry", "correlated", classify.severity(F.col("form"), F.col("kind"), F.col("ancestry"), F.col("correlated")).alias("severity"))


VERSIONS = [("0.1.1", "0.1.1"), ("0.1.0", "0.1.1"), ("0.1.1-dev", "0.1.1"), ("0.10.0", "0.9.9"), ("1", "0.9.9"), ("1.0", "1.0.0"), ("", "0.0.1"), ("x.2", "0.2"), ("2.0.0.1", "2"), ("1.2.3", "1.2.4"), ("0.1.1", "0.1"), ("10", "9.9.9.9"), ("1.0.0.0.0.0.0.0.0.1", "1.0.0.0.0.0.0.0.0.2"), ("1.0.0.0.0.0.0.0.0.0.3", "1")]
NUMBERS_SQL = "list_transform(range(1, 1 + greatest(len(string_split(version, '.')), len(string_split(minimum, '.')))), lambda i: coalesce(try_cast(regexp_extract(coalesce(string_split({v}, '.')[i], ''), '^[0-9]*') AS BIGINT), 0))"


@query(f"SELECT version, minimum, {NUMBERS_SQL.format(v='version')} >= {NUMBERS_SQL.format(v='minimum')} AS at_least FROM ({values_sql(VERSIONS)}) t(version, minimum)")
def q03_version_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline(spark, VERSIONS, "version string, minimum string").withColumn("at_least", refs.version_at_least(F.col("version"), F.col("minimum")))


REFUSALS = [(s, r, a, j) for s in (301, 304, 403, 404, 422, 429, 500, 503, 599, 0) for r, a, j in ((None, 0, 0), (30, 3, 5), (None, 3, 7), (None, 20, 1))]


@query(f"""SELECT status, retry_after, attempt, jitter,
  CASE WHEN status IN (403, 429) THEN 'secondary_rate_limit' WHEN status BETWEEN 400 AND 499 THEN 'api_client' WHEN status BETWEEN 500 AND 599 THEN 'api_server' ELSE 'upstream' END AS error_class,
  CASE WHEN status IN (403, 429) THEN coalesce(retry_after::BIGINT, (60 * pow(2, least(attempt, 16)))::BIGINT + jitter) END AS backoff
FROM ({values_sql(REFUSALS)}) t(status, retry_after, attempt, jitter)""")
def q04_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, REFUSALS, "status int, retry_after int, attempt int, jitter int")
    wait = classify.backoff_seconds(F.col("retry_after").cast("long"), F.col("attempt"), F.col("jitter"))
    return rows.withColumns({"error_class": classify.error_class(F.col("status")), "backoff": F.when(F.col("status").isin(403, 429), wait)})


@query("SELECT event_id, epoch_us(ts) - (((epoch_us(ts) - 120000000) % 300000000 + 300000000) % 300000000) AS slot_us FROM events")
def q05_cron_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.cron_slot(F.col("ts")).alias("slot_us"))


@query("""SELECT strftime(ts, '%Y/%m/%d') || '/acme--r' || (user_id % 10)::VARCHAR || '.jsonl' AS file, count(*) AS n, min(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z') AS first_at
FROM events GROUP BY 1""")
def q06_day_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    slug = F.concat(F.lit("acme/r"), (F.col("user_id") % 10).cast("string"))
    file = F.concat(F.date_format(times.instant(F.col("ts")), "yyyy/MM/dd"), F.lit("/"), refs.path_segment(slug), F.lit(".jsonl"))
    return e.groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.min(times.wire(F.col("ts"))).alias("first_at"))


KEY, ORDER = ["repo", "ref"], ["us", "event_id"]
MOVES_SQL = f"""WITH {OBS_SQL}, ok AS (SELECT *,
  lag(commit_no) OVER w AS prev_commit_no, lag(tree_no) OVER w AS prev_tree_no, lag(us) OVER w AS prev_us, lag(event_id) OVER w AS prev_event_id
  FROM obs WHERE outcome = 'ok' WINDOW w AS (PARTITION BY repo, ref ORDER BY us, event_id)),
mv AS (SELECT * FROM ok WHERE prev_commit_no <> commit_no)"""


def ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where("outcome = 'ok'")


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.moves(ok(spark, sf_dir), KEY, ORDER, "commit_no", ["tree_no", "us", "event_id"])


@query(MOVES_SQL + " SELECT repo, ref, event_id, prev_event_id, prev_commit_no AS from_commit, commit_no AS to_commit FROM mv")
def q07_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir).select("repo", "ref", "event_id", "prev_event_id", F.col("prev_commit_no").alias("from_commit"), F.col("commit_no").alias("to_commit"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT *, CASE WHEN lag(commit_no) OVER w = commit_no THEN 0 ELSE 1 END AS ch FROM obs WHERE outcome = 'ok' WINDOW w AS (PARTITION BY repo, ref ORDER BY us, event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY repo, ref ORDER BY us, event_id) AS island FROM c)
SELECT repo, ref, island::BIGINT AS island, any_value(commit_no) AS commit_no, min(us) AS first_observed, max(us) AS last_observed, count(*) AS observation_count,
       ((max(us) - min(us)) // 86400000000)::BIGINT AS stable_days FROM i GROUP BY 1, 2, 3""")
def q08_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bindings.runs(ok(spark, sf_dir), KEY, ORDER, "commit_no", "us")
    return out.withColumn("stable_days", ledger.stable_days(F.col("first_observed"), F.col("last_observed")))


def by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ok(spark, sf_dir).withColumn("day", F.to_date(F.timestamp_micros("us")))


@query(f"""WITH {OBS_SQL}, d AS (SELECT DISTINCT repo, ref, make_timestamp(us)::DATE AS day FROM obs WHERE outcome = 'ok'),
pairs AS (SELECT repo, ref, day + 1 AS day FROM d WHERE day < (SELECT max(day) FROM d))
SELECT repo, ref, strftime(day, '%Y-%m-%d') AS deleted_on FROM (SELECT repo, ref, day::DATE AS day FROM pairs EXCEPT SELECT repo, ref, day FROM d)
WHERE (repo, day) IN (SELECT (repo, day) FROM d)""")
def q09_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = by_day(spark, sf_dir).select("repo", "ref", "day").distinct()
    expected = listing.withColumn("day", F.date_add("day", 1))
    gone = bindings.absent(expected, listing, ["repo", "ref", "day"])
    # absence tells something only on days on which the repository was listed
    return gone.join(listing.select("repo", "day").distinct(), ["repo", "day"], "left_semi").select("repo", "ref", F.date_format("day", "yyyy-MM-dd").alias("deleted_on"))


@query(f"""WITH {OBS_SQL}, d AS (SELECT DISTINCT repo, ref, make_timestamp(us)::DATE AS day FROM obs WHERE outcome = 'ok'),
l AS (SELECT *, lag(day) OVER (PARTITION BY repo, ref ORDER BY day) AS p FROM d)
SELECT repo, ref, strftime(day, '%Y-%m-%d') AS day, strftime(p, '%Y-%m-%d') AS last_day, (day - p)::INTEGER AS gap_days FROM l WHERE day - p > 1""")
def q10_recreations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bindings.recreations(by_day(spark, sf_dir), KEY, "day")
    return out.select("repo", "ref", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("prev_day", "yyyy-MM-dd").alias("last_day"), "gap_days")


@query(MOVES_SQL + " SELECT event_id, ((us // 1000 - prev_us // 1000) // 1000)::BIGINT AS window_seconds FROM mv")
def q11_window_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir).select("event_id", times.window_seconds(F.col("prev_us"), F.col("us")).alias("window_seconds"))


COMPARED = [(0, 1, "ahead"), (1, 0, "behind"), (1, 2, "ahead"), (2, 1, "diverged"), (2, 3, "ahead"), (3, 2, "behind"), (3, 0, "identical")]
KIND_SQL = "CASE WHEN commit_no = prev_commit_no THEN 'release_level_only' WHEN tree_no = prev_tree_no THEN 'commit_metadata_only' ELSE 'content_change' END"


@query(MOVES_SQL + f""", n AS (SELECT mv.*, regexp_replace(ref, '^refs/tags/', '') AS b, {KIND_SQL} AS kind, a.ancestry, false AS correlated
FROM mv LEFT JOIN ({values_sql(COMPARED)}) a(f, t, ancestry) ON prev_commit_no = f AND commit_no = t), m AS (SELECT *, {FORM_SQL} AS form FROM n)
SELECT event_id, form, kind, ancestry, {SEVERITY_SQL} AS severity FROM m""")
def q12_move_kind_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = inline(spark, COMPARED, "prev_commit_no long, commit_no long, ancestry string")
    kind = classify.move_kind(F.col("prev_commit_no"), F.col("commit_no"), F.col("prev_tree_no"), F.col("tree_no"))
    out = moved(spark, sf_dir).join(F.broadcast(compared), ["prev_commit_no", "commit_no"], "left").withColumns({"form": refs.ref_form(F.col("ref")), "kind": kind})
    return out.select("event_id", "form", "kind", "ancestry", classify.severity(F.col("form"), F.col("kind"), F.col("ancestry"), F.lit(False)).alias("severity"))


BATCH_SQL = MOVES_SQL + """, x AS (SELECT *, list_sort(list_distinct(list(ref) OVER w)) AS members, min(us) OVER w AS batch_start
  FROM mv WHERE ref IN ('v1.2.3', 'v1.2.4', 'v2.0.0-rc.1', 'v3.0.0') WINDOW w AS (PARTITION BY repo, commit_no ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
bt AS (SELECT *, 'corr-c' || commit_no::VARCHAR || '-' || (batch_start // 1000000)::VARCHAR AS batch_id FROM x WHERE len(members) >= 3)"""


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = moved(spark, sf_dir).where(refs.ref_form(F.col("ref")) == "exact")  # only moves of exact references make a batch
    out = classify.batches(exact, ["repo", "commit_no"], "us", DAY, "ref")
    return out.withColumn("batch_id", classify.batch_id(F.concat(F.lit("c"), F.col("commit_no").cast("string")), F.col("batch_start")))


@query(BATCH_SQL + " SELECT event_id, repo, commit_no, batch_id, len(members)::INTEGER AS n_members, array_to_string(members, ',') AS members FROM bt")
def q13_correlation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir).select("event_id", "repo", "commit_no", "batch_id", F.size("members").alias("n_members"), F.array_join("members", ",").alias("members"))


@query(BATCH_SQL + """, u AS (SELECT repo, batch_id, unnest(members) AS ref, max(us) OVER (PARTITION BY repo, batch_id) AS upto FROM bt),
s AS (SELECT u.repo, u.batch_id, u.ref, max(o.event_id) AS seq FROM (SELECT DISTINCT repo, batch_id, ref, upto FROM u) u JOIN mv o ON o.repo = u.repo AND o.ref = u.ref AND o.us <= u.upto GROUP BY 1, 2, 3)
SELECT repo, batch_id, array_to_string(list_sort(list(DISTINCT seq)), ',') AS member_seqs, array_to_string(list_sort(list(DISTINCT ref)), ',') AS refs FROM s GROUP BY 1, 2""")
def q14_correlation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batched(spark, sf_dir)
    last = b.groupBy("repo", "batch_id").agg(F.max("us").alias("us"), F.array_distinct(F.flatten(F.collect_set("members"))).alias("m"))
    member = last.select("repo", "batch_id", "us", F.explode("m").alias("ref"))
    seen = moved(spark, sf_dir).select("repo", "ref", "us", F.col("event_id").alias("seq"))
    seq = classify.latest_by(member, seen, KEY, "us", "seq")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return seq.groupBy("repo", "batch_id").agg(joined("seq").alias("member_seqs"), joined("ref").alias("refs"))


DIGEST_SQL = f"""WITH {OBS_SQL}, c AS (SELECT make_timestamp(us)::DATE AS day, repo, outcome FROM obs),
g AS (SELECT day, count(DISTINCT repo) AS repos_polled, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'not_modified') AS not_modified, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM c GROUP BY 1),
dg AS (SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(repos_polled, 0) AS repos_polled, coalesce(ok, 0) AS ok, coalesce(not_modified, 0) AS not_modified, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped
FROM (SELECT unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN g ON g.day = d.day)"""


@query(DIGEST_SQL + " SELECT * FROM dg")
def q15_daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.daily_digest(observations(spark, sf_dir), F.to_date(F.timestamp_micros("us")), "repo", F.col("outcome"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(DIGEST_SQL + " SELECT count(*) AS days, sum(skipped)::BIGINT AS skipped, sum(failed)::BIGINT AS failed, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (ok + not_modified + failed + skipped = 0) AS quiet_days FROM dg")
def q16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = q15_daily_digest(spark, sf_dir)
    return d.agg(F.count("*").alias("days"), F.sum("skipped").alias("skipped"), F.sum("failed").alias("failed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("ok") + F.col("not_modified") + F.col("failed") + F.col("skipped") == 0).alias("quiet_days"))


@query("""SELECT o_orderkey, 'sha256:' || sha256('{"o_custkey":' || o_custkey::VARCHAR || ',"o_orderkey":' || o_orderkey::VARCHAR || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS entry_hash FROM orders""")
def q17_entry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", canonical.entry_hash(o).alias("entry_hash"))


HOLES_SQL = "WITH o AS (SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 97 <> 0), l AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM o)"


@query(HOLES_SQL + " SELECT p AS last_seq, seq AS next_seq, seq - p - 1 AS missing FROM l WHERE seq <> p + 1")
def q18_chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("seq"))
    return ledger.gaps(rows, "seq")


@query("""WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS seq,
  '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey::VARCHAR || ',"n_regionkey":' || n_regionkey::VARCHAR || ',"prev_hash":"' AS head FROM nation),
r AS (SELECT seq, n_nationkey, 'sha256:' || repeat('0', 64) AS prev_hash, 'sha256:' || sha256(head || 'sha256:' || repeat('0', 64) || '","seq":0}') AS entry_hash FROM n WHERE seq = 0
  UNION ALL SELECT n.seq, n.n_nationkey, r.entry_hash, 'sha256:' || sha256(n.head || r.entry_hash || '","seq":' || n.seq::VARCHAR || '}') FROM r JOIN n ON n.seq = r.seq + 1)
SELECT seq, n_nationkey, prev_hash, entry_hash FROM r""")
def q19_hash_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return ledger.link(n, ["n_nationkey"]).select("seq", "n_nationkey", "prev_hash", "entry_hash")


@query(HOLES_SQL + """, v AS (SELECT seq, 3 AS rank, 'sequence gap at seq ' || (p + 1)::VARCHAR AS what FROM l WHERE seq <> p + 1
  UNION ALL SELECT o_orderkey, 4, 'hash mismatch' FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 1009 = 98)
SELECT seq, rank, what FROM v ORDER BY seq, rank LIMIT 1""")
def q20_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("seq"))
    holes = ledger.gaps(rows, "seq").select(F.col("next_seq").alias("seq"), F.lit(3).alias("rank"), F.concat(F.lit("sequence gap at seq "), (F.col("last_seq") + 1).cast("string")).alias("what"))
    wrong = rows.where("seq % 1009 = 98").select("seq", F.lit(4).alias("rank"), F.lit("hash mismatch").alias("what"))
    return ledger.first_failure(holes.unionByName(wrong))


@query("""SELECT n_nationkey::BIGINT AS seq, 5 + n.rank AS rank, n.what FROM nation, (VALUES (0, 'hash mismatch'), (1, 'broken link'), (-1, 'sequence gap at seq 20')) n(rank, what)
WHERE CASE n.what WHEN 'hash mismatch' THEN n_nationkey % 7 = 3 WHEN 'broken link' THEN n_nationkey = 21 ELSE n_nationkey = 21 END""")
def q47_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds where rows of a linked ledger were changed and one was taken out."""
    none = spark.createDataFrame([], schemas.ENTRY).drop("seq", "prev_hash", "entry_hash")
    own = {"event": F.lit("correction"), "format_version": F.lit(1), "corrects_seq": F.lit(0).cast("long"), "reason": F.col("n_name"), "recorded_at": F.lit("2026-01-01T00:00:00.000Z")}
    rows = table(spark, sf_dir, "nation").select("n_nationkey", *[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in none.schema])
    linked = ledger.link(rows.withColumn("detection_latency_note", F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).drop("n_nationkey"), ["detection_latency_note"])
    changed = linked.withColumn("reason", F.when(F.col("seq") % 7 == 3, F.concat("reason", F.lit("!"))).otherwise(F.col("reason"))).where("seq <> 20")
    found = ledger.violations(changed)
    kinds = {"sequence gap": 4, "hash mismatch": 5, "broken link": 6}
    rank = F.coalesce(*[F.when(F.startswith("what", F.lit(k)), F.lit(v)) for k, v in kinds.items()])
    return found.select("seq", rank.alias("rank"), "what")


@query("SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q21_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", times.micros(F.col("ts")).alias("us"))
    return ledger.latest(e, ["user_id"], ["us", "event_id"])


@query("SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS different FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1")
def q22_head_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.disagreeing(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders WHERE o_orderstatus = 'O' AND epoch_us(o_orderdate) <= (SELECT max(epoch_us(o_orderdate)) FROM orders) - 48 * 3600000000")
def q23_backlog_48h(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", times.micros(F.col("o_orderdate")).alias("us"))
    return ledger.backlog(o, "us", 48, F.col("o_orderstatus") == "O").select("o_orderkey", "us")


GAPS_SQL = f"""WITH {OBS_SQL}, i AS (SELECT user_id, us, lead(us) OVER w AS nx, lag(us) OVER w AS pv FROM (SELECT DISTINCT user_id, us FROM obs) WINDOW w AS (PARTITION BY user_id ORDER BY us)),
gp AS (SELECT o.user_id, o.event_id, CASE WHEN k % 2 = 0 THEN 'scheduler_lag' ELSE 'secondary_limit_backoff' END AS kind,
  CASE WHEN k % 2 = 0 THEN coalesce(pv, o.us) ELSE o.us END AS gap_from, CASE WHEN k % 2 = 0 THEN o.us ELSE coalesce(nx, o.us) END AS gap_to
  FROM obs o JOIN i ON i.user_id = o.user_id AND i.us = o.us WHERE outcome = 'skipped')"""


def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("outcome") == "skipped", F.when(F.col("k") % 2 == 0, "scheduler_lag").otherwise("secondary_limit_backoff"))
    return score.recorded_gaps(observations(spark, sf_dir), ["user_id"], "us", kind).select("user_id", "event_id", "kind", "gap_from", "gap_to")


@query(GAPS_SQL + " SELECT * FROM gp")
def q24_gap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipped(spark, sf_dir)


CONTAINED_SQL = GAPS_SQL + """, a AS (SELECT event_id AS action_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
c AS (SELECT a.action_id, a.us, g.gap_from, g.gap_to, g.kind FROM a LEFT JOIN gp g ON g.user_id = a.user_id AND a.us >= g.gap_from AND a.us <= g.gap_to
  QUALIFY row_number() OVER (PARTITION BY a.action_id ORDER BY g.gap_from NULLS LAST, g.event_id) = 1)"""


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("action_id"), "user_id", times.micros(F.col("ts")).alias("us"))
    return score.first_covering(actions, skipped(spark, sf_dir), ["user_id"], "us", 12 * HOUR, "action_id", ["event_id"])


@query(CONTAINED_SQL + " SELECT action_id, us, gap_from, gap_to, kind FROM c")
def q25_gap_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir).select("action_id", "us", "gap_from", "gap_to", "kind")


AFTER_SQL = """WITH j AS (SELECT o_orderkey, epoch_us(o_orderdate) AS ordered_us, epoch_us(l_shipdate) AS shipped_us, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber) = 1)"""


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", times.micros(F.col("o_orderdate")).alias("ordered_us"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), times.micros(F.col("l_shipdate")).alias("shipped_us"), "l_linenumber")
    return score.first_after(o, line, ["o_orderkey"], "ordered_us", "shipped_us", ["l_linenumber"], ["l_linenumber"])


@query(AFTER_SQL + " SELECT * FROM j")
def q26_forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipped(spark, sf_dir)


@query(AFTER_SQL + """, s AS (SELECT list_sort(list((greatest(shipped_us - ordered_us, 0) // 1000000)::BIGINT)) AS v FROM j)
SELECT len(v)::BIGINT AS n, v[(50 * (len(v) - 1)) // 100 + 1] AS p50, v[(95 * (len(v) - 1)) // 100 + 1] AS p95, v[(100 * (len(v) - 1)) // 100 + 1] AS p100 FROM s""")
def q27_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = shipped(spark, sf_dir).select(score.latency_seconds(F.col("ordered_us"), F.col("shipped_us")).alias("latency"))
    return score.floor_percentiles(latency, "latency", [50, 95, 100])


PATTERNS = [*score.EXPECTED, *score.RETIRED, *score.CREATION, "unheard_of"]


@query(CONTAINED_SQL + f""", p AS (SELECT *, {PATTERNS}[(action_id % {len(PATTERNS)} + 1)::INTEGER] AS pattern, action_id % 23 = 0 AS manual, action_id % 3 <> 0 AS detected, action_id % 5 <> 0 AS right_class, (SELECT min(us) + 86400000000 FROM obs) AS added FROM c)
SELECT CASE WHEN manual THEN 'manual' WHEN pattern IN ('lightweight_annotated_roundtrip', 'delete_recreate') THEN 'retired'
  WHEN pattern IN ('bootstrap', 'creation', 'create', 'unheard_of') THEN 'creation' WHEN us <= added THEN 'pre_genesis' WHEN gap_from IS NOT NULL THEN 'during_gap'
  WHEN NOT detected THEN 'missed' WHEN NOT right_class THEN 'misclassified' ELSE 'detected' END AS bucket, count(*) AS n FROM p GROUP BY 1""")
def q28_score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = observations(spark, sf_dir).agg((F.min("us") + DAY).alias("added"))
    a, c = contained(spark, sf_dir).join(F.broadcast(first)), F.col
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (c("action_id") % len(PATTERNS) + 1).cast("int"))
    b = score.bucket(c("action_id") % 23 == 0, pattern, c("us"), c("added"), c("gap_from").isNotNull(), c("action_id") % 3 != 0, c("action_id") % 5 != 0)
    return a.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {OBS_SQL}, l AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS silence FROM obs) SELECT user_id, event_id, silence FROM l WHERE silence > 86400000000")
def q29_schedule_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = bindings.with_previous(observations(spark, sf_dir), ["user_id"], ORDER, ["us"])
    return before.withColumn("silence", F.col("us") - F.col("prev_us")).where(F.col("silence") > DAY).select("user_id", "event_id", "silence")


@query("""SELECT l_suppkey, count(*) AS n_paths, string_agg(coalesce(p, '-'), ',' ORDER BY p NULLS FIRST) AS paths FROM (SELECT DISTINCT l_suppkey, CASE WHEN l_partkey % 5 > 0 THEN 'p' || (l_partkey % 5)::VARCHAR END AS p FROM lineitem) GROUP BY 1""")
def q30_poll_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")))
    out = population.poll_groups(table(spark, sf_dir, "lineitem").select("l_suppkey", path.alias("path")), "l_suppkey", "path")
    return out.select("l_suppkey", F.size("paths").cast("long").alias("n_paths"), F.array_join(F.transform("paths", lambda p: F.coalesce(p, F.lit("-"))), ",").alias("paths"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_suppkey * 7 % 100 + l_linenumber % 2 AS dst FROM lineitem),
r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def q31_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") * 7 % 100 + F.col("l_linenumber") % 2).alias("dst"))
    return population.closure(inline(spark, [(1,)], "node long"), edges, 4)


TEXTS = [("a", "steps:\n  - uses: actions/checkout@v4\n  - uses: 'acme/tool/sub/dir@abc'\n"), ("b", "# uses: no/no@v1\n  Uses: \"own/er@v1@v2\"\nuses: ./local@v1\nuses: docker://x@y\nuses: bad\nuses: only@v1\n"), ("c", ""), ("d", "-uses:  x/y@z  \nuse: q/r@s")]


@query(f"""WITH t AS (SELECT id, unnest(string_split(txt, chr(10))) AS line FROM ({values_sql([(a, b) for a, b in TEXTS])}) t(id, txt)),
v AS (SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(line, '^\\s*(-\\s*)?uses:', '', 'i')), '^"+', ''), '"+$', '')), '^''+', ''), '''+$', '')) AS v FROM t WHERE regexp_matches(line, '^\\s*(-\\s*)?uses:', 'i')),
k AS (SELECT id, regexp_extract(v, '^(.*)@[^@]+$', 1) AS lft, regexp_extract(v, '@([^@]+)$', 1) AS rev FROM v WHERE NOT starts_with(v, './') AND v <> '.' AND NOT starts_with(v, 'docker://') AND regexp_matches(v, '^[^/]*/.*@[^@]+$')),
p AS (SELECT id, split_part(lft, '/', 1) || '/' || split_part(lft, '/', 2) AS repo, CASE WHEN len(string_split(lft, '/')) > 2 THEN array_to_string(string_split(lft, '/')[3:], '/') END AS path, rev FROM k)
SELECT id, repo, path, rev, concat_ws('@', repo, path, rev) AS via FROM p""")
def q32_uses_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, TEXTS, "id string, txt string").select("id", F.explode(refs.uses_references(F.col("txt"))).alias("u"))
    return rows.select("id", "u.*").withColumn("via", refs.via(F.col("repo"), F.col("path"), F.col("rev")))


@query(f"""WITH {OBS_SQL} SELECT event_id, (sum(CASE WHEN outcome = 'not_modified' THEN 0 ELSE 1 END) OVER w)::BIGINT AS primary_points, count(*) OVER w AS secondary_points FROM obs
WINDOW w AS (PARTITION BY repo ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def q33_points_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("repo").orderBy("us").rangeBetween(-HOUR, 0)
    charged = F.when(F.col("outcome") == "not_modified", 0).otherwise(1)
    return observations(spark, sf_dir).select("event_id", F.sum(charged).over(w).alias("primary_points"), F.count("*").over(w).alias("secondary_points"))


@query(f"""WITH {OBS_SQL} SELECT repo, ref, min(us) AS earliest_us, arg_min(event_id, us) AS earliest_id, max(us) AS latest_us, max(us) FILTER (outcome = 'ok') AS latest_ok_us FROM obs GROUP BY 1, 2""")
def q34_earliest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(*KEY).agg(F.min("us").alias("earliest_us"), F.min_by("event_id", "us").alias("earliest_id"), F.max("us").alias("latest_us"), F.max(F.when(F.col("outcome") == "ok", F.col("us"))).alias("latest_ok_us"))


@query(f"""WITH {OBS_SQL}, w AS (SELECT c_custkey % 200 AS repo, CASE WHEN c_custkey % 3 > 0 THEN 'p' || (c_custkey % 3)::VARCHAR END AS path, min(c_custkey) AS key_no FROM customer GROUP BY 1, 2),
s AS (SELECT user_id AS repo, CASE WHEN k % 3 > 0 THEN 'p' || (k % 3)::VARCHAR END AS path, min(us) AS us, arg_min(event_id, us) AS event_id FROM obs WHERE k % 4 = 0 GROUP BY 1, 2),
n AS (SELECT * FROM w WHERE key_no % 7 <> 0), a AS (SELECT repo, min(us) AS us, arg_min(event_id, us) AS event_id FROM s GROUP BY 1)
SELECT n.repo, n.path, n.key_no, coalesce(s.us, a.us) AS us, CASE WHEN s.us IS NOT NULL THEN s.event_id ELSE a.event_id END AS event_id
FROM n LEFT JOIN s ON s.repo = n.repo AND s.path IS NOT DISTINCT FROM n.path LEFT JOIN a ON a.repo = n.repo WHERE coalesce(s.us, a.us) IS NOT NULL""")
def q35_genesis_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.when(F.col(c) % 3 > 0, F.concat(F.lit("p"), (F.col(c) % 3).cast("string")))
    watched = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 200).alias("repo"), path("c_custkey").alias("path")).agg(F.min("c_custkey").alias("key_no"))
    added = watched.where("key_no % 7 = 0").select("repo", "path")
    seen = population.earliest(observations(spark, sf_dir).where("k % 4 = 0").select(F.col("user_id").alias("repo"), path("k").alias("path"), "us", "event_id"), ["repo", "path"], "us", "event_id")
    return population.registrations(watched, seen, added, "repo", "path", "us", "event_id")


ROTATIONS = [(0, ["a", "b", "c"]), (86_399_000_000 + 40 * DAY, ["a", "b", "c", "d", "e"]), (7 * HOUR + 200 * DAY, ["x"]), (13 * HOUR, [])]


@query(f"""WITH t AS (SELECT us, list_filter(g, lambda x: x IS NOT NULL) AS g FROM ({values_sql([(a, b or [None]) for a, b in ROTATIONS])}) t(us, g)),
o AS (SELECT *, CASE WHEN len(g) = 0 THEN 0 ELSE ((dayofyear(make_timestamp(us)) * 288 + (hour(make_timestamp(us)) * 60 + minute(make_timestamp(us))) // 5) % len(g))::INTEGER END AS o FROM t)
SELECT us, o AS start, array_to_string(list_concat(g[o + 1:], g[:o]), ',') AS groups FROM o""")
def q36_fair_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, ROTATIONS, "us long, g array<string>").withColumn("start", times.rotation_offset(F.col("us"), F.size("g")))
    return rows.select("us", "start", F.array_join(times.rotated(F.col("g"), F.col("start")), ",").alias("groups"))


@query(MOVES_SQL + """, x AS (SELECT commit_no AS c, min(tree_no) + (commit_no % 3 = 2)::INTEGER AS cached FROM obs GROUP BY 1)
SELECT event_id, concat_ws('; ', CASE WHEN tree_no = commit_no THEN 'tree equals commit' WHEN b.cached <> tree_no THEN 'to tree ' || tree_no::VARCHAR || ' disagrees with ' || b.cached::VARCHAR END,
  CASE WHEN prev_tree_no = prev_commit_no THEN 'from tree equals commit' WHEN a.cached <> prev_tree_no THEN 'from tree ' || prev_tree_no::VARCHAR || ' disagrees with ' || a.cached::VARCHAR END) AS reason, coalesce(b.cached, tree_no)::BIGINT AS healed_tree
FROM mv LEFT JOIN x a ON a.c = prev_commit_no LEFT JOIN x b ON b.c = commit_no""")
def q37_tree_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = observations(spark, sf_dir).groupBy("commit_no").agg((F.min("tree_no") + F.max((F.col("commit_no") % 3 == 2).cast("int"))).alias("cached"))
    out = moved(spark, sf_dir).join(cache.withColumnRenamed("cached", "to_cached"), "commit_no", "left")
    out = out.join(cache.select(F.col("commit_no").alias("prev_commit_no"), F.col("cached").alias("from_cached")), "prev_commit_no", "left")

    def reason(side: str, commit: str, tree: str, cached: str, alone: str):
        differs = F.concat(F.lit(side + " tree "), F.col(tree).cast("string"), F.lit(" disagrees with "), F.col(cached).cast("string"))
        return F.when(F.col(tree) == F.col(commit), alone).when(F.col(cached) != F.col(tree), differs)

    why = F.concat_ws("; ", reason("to", "commit_no", "tree_no", "to_cached", "tree equals commit"), reason("from", "prev_commit_no", "prev_tree_no", "from_cached", "from tree equals commit"))
    return out.select("event_id", why.alias("reason"), F.coalesce("to_cached", "tree_no").alias("healed_tree"))


STATUSES = [("a", ["added", "added", "removed", "modified"]), ("b", []), ("c", ["renamed", "copied", "changed"]), ("d", ["modified"] * 300)]


@query(f"""WITH t AS (SELECT id, list_filter(f, lambda x: x IS NOT NULL) AS f FROM ({values_sql([(a, b or [None]) for a, b in STATUSES])}) t(id, f))
SELECT id, len(list_filter(f, lambda x: x = 'added'))::BIGINT AS files_added, len(list_filter(f, lambda x: x = 'removed'))::BIGINT AS files_removed, len(list_filter(f, lambda x: x = 'renamed'))::BIGINT AS files_renamed,
  len(list_filter(f, lambda x: x NOT IN ('added', 'removed', 'renamed')))::BIGINT AS files_modified, len(f) >= 300 AS possibly_truncated FROM t""")
def q38_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, STATUSES, "id string, f array<string>").withColumn("files", F.transform("f", lambda x: F.struct(x.alias("status"))))
    return rows.select("id", *[c.alias(n) for n, c in classify.diff_counts(F.col("files")).items()])


SAMPLES = [(run, mode, rpm, 429 if rpm >= limit else 200) for run, limits in (("r1", (900, 900)), ("r2", (1200, 500)), ("r3", (300, 800)), ("r4", (5000, 5000)), ("r5", (400, 5000))) for mode, limit in zip("AB", limits, strict=True) for rpm in range(100, 1300, 100)]


@query(f"""WITH t AS (SELECT run, min(rpm) FILTER (mode = 'A' AND status IN (403, 429)) AS a, min(rpm) FILTER (mode = 'B' AND status IN (403, 429)) AS b FROM ({values_sql(SAMPLES)}) t(run, mode, rpm, status) GROUP BY 1)
SELECT run, a AS first_a, b AS first_b, CASE WHEN a IS NULL AND b IS NULL THEN 'not reached' WHEN a IS NULL OR b IS NULL THEN 'incomplete' WHEN abs(a - b) <= 100 THEN 'per template' WHEN a > b + 100 THEN 'per address' ELSE 'ambiguous' END AS reading FROM t""")
def q39_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda m: F.min(F.when((F.col("mode") == m) & F.col("status").isin(403, 429), F.col("rpm")))
    out = inline(spark, SAMPLES, "run string, mode string, rpm int, status int").groupBy("run").agg(first("A").alias("first_a"), first("B").alias("first_b"))
    return out.withColumn("reading", population.throttle_reading(F.col("first_a"), F.col("first_b"), F.lit(100)))


@query(f"""WITH {OBS_SQL}, d AS (SELECT repo, ref, make_timestamp(us)::DATE AS day, arg_max(commit_no, (us, event_id)) AS c FROM obs WHERE outcome = 'ok' GROUP BY 1, 2, 3),
n AS (SELECT min(day) + 9 AS a FROM d), p AS (SELECT repo, ref, c FROM d, n WHERE day = a), q AS (SELECT repo, ref, c FROM d, n WHERE day = a + 1)
SELECT count(*) FILTER (p.c <> q.c) AS changed, count(*) FILTER (q.c IS NULL) AS deleted, count(*) FILTER (p.c IS NULL) AS created, count(*) FILTER (p.c <> q.c OR q.c IS NULL) AS movement FROM p FULL JOIN q ON p.repo = q.repo AND p.ref = q.ref""")
def q40_movement_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = by_day(spark, sf_dir)
    last = ledger.latest(listed.select("repo", "ref", "day", "us", "event_id", "commit_no"), ["repo", "ref", "day"], ORDER)
    first = listed.agg(F.date_add(F.min("day"), 9).alias("_a"))
    last = last.join(F.broadcast(first))
    return bindings.movement_count(last.where("day = _a"), last.where("day = date_add(_a, 1)"), KEY, "commit_no")


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, sum((outcome = 'ok')::INTEGER) OVER v AS oks FROM obs WINDOW v AS (PARTITION BY repo, ref ORDER BY us, event_id))
SELECT event_id, (sum(CASE WHEN outcome = 'ok' OR (outcome = 'not_modified' AND oks > 0) THEN 1 ELSE 0 END) OVER (PARTITION BY repo, ref ORDER BY us, event_id))::BIGINT AS with_not_modified, oks::BIGINT AS ok_only FROM w""")
def q41_304_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    out = bindings.live_counts(o, KEY, ORDER, F.col("outcome"), True).withColumnRenamed("observation_count", "with_not_modified")
    return bindings.live_counts(out, KEY, ORDER, F.col("outcome"), False).select("event_id", "with_not_modified", F.col("observation_count").alias("ok_only"))


@query(f"""WITH {OBS_SQL}, x AS (SELECT *, k % 7 <> 0 AS resolved FROM obs WHERE outcome = 'ok'),
c AS (SELECT *, CASE WHEN lag(resolved) OVER w = resolved AND lag(commit_no) OVER w = commit_no THEN 0 ELSE 1 END AS ch FROM x WINDOW w AS (PARTITION BY repo, ref ORDER BY us, event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY repo, ref ORDER BY us, event_id) AS island FROM c),
r AS (SELECT repo, ref, island, any_value(resolved) AS resolved, any_value(commit_no) AS commit_no, min(us) AS first_us, count(*) AS n FROM i GROUP BY 1, 2, 3),
l AS (SELECT *, lag(resolved) OVER w AS pr, lag(commit_no) OVER w AS pc, lag(first_us) OVER w AS first_seen, lag(n) OVER w AS held FROM r WINDOW w AS (PARTITION BY repo, ref ORDER BY island))
SELECT repo, ref, commit_no, first_seen, first_us AS released_at, held FROM l WHERE resolved AND NOT pr AND pc = commit_no""")
def q42_deferred_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.deferred(ok(spark, sf_dir), KEY, ORDER, F.col("k") % 7 != 0, "commit_no", "us")


ENTRIES = [
    (1, "move", "a", "b", "content_change", "high", 60, ["x", "y"], None, None, None, None, None, None), (2, "move", None, "b", "content_change", None, 0, ["x"], None, None, None, None, None, None),
    (3, "recreation", "a", "b", "content_change", "info", 5, ["x", "y"], None, None, None, None, None, None), (4, "correlation", None, None, None, None, None, None, None, [1, 4], None, None, None, None),
    (5, "correlation", None, None, None, None, None, None, None, [], None, None, None, None), (6, "repo_unavailable", None, None, None, None, None, None, None, None, None, None, None, None),
    (7, "repo_redirected", None, None, None, None, None, None, None, None, 301, None, None, None), (8, "correction", None, None, None, None, None, None, None, None, None, None, None, "why"),
    (9, "deletion", "a", "b", "content_change", "info", 1, ["x", "y", "z"], None, None, None, None, None, None), (10, "correlation", None, None, None, None, None, None, None, [1, 2, 9], None, None, None, None),
]
ENTRY = "seq long, event string, from string, to string, classification string, severity string, observation_window_seconds long, source_observations array<string>, gap_seconds long, member_seqs array<long>, http_status int, redirect_location string, corrects_seq long, reason string"


@query(f"""WITH e AS (SELECT *, event IN ('move', 'deletion', 'recreation') AS bound FROM ({values_sql(ENTRIES)}) t({", ".join('"' + x.split()[0] + '"' for x in ENTRY.split(", "))}))
SELECT seq, concat_ws(', ', CASE WHEN bound AND ("from" IS NULL OR "to" IS NULL) THEN 'binding missing' END, CASE WHEN bound AND (classification IS NULL OR severity IS NULL) THEN 'classification or severity missing' END,
  CASE WHEN bound AND NOT coalesce(observation_window_seconds > 0, false) THEN 'window not positive' END, CASE WHEN bound AND coalesce(len(source_observations), 0) < 2 THEN 'fewer than two sources' END,
  CASE WHEN event = 'recreation' AND gap_seconds IS NULL THEN 'gap missing' END, CASE WHEN event = 'correlation' AND coalesce(len(member_seqs), 0) < 1 THEN 'correlation empty' END,
  CASE WHEN event = 'correlation' AND coalesce(list_max(member_seqs), 0) >= seq THEN 'correlation member not before its row' END, CASE WHEN event IN ('repo_unavailable', 'repo_redirected') AND http_status IS NULL THEN 'status missing' END,
  CASE WHEN event = 'repo_redirected' AND redirect_location IS NULL THEN 'location missing' END, CASE WHEN event = 'correction' AND (corrects_seq IS NULL OR reason IS NULL) THEN 'correction without target or reason' END) AS problems FROM e""")
def q43_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.problems(inline(spark, ENTRIES, ENTRY), ledger.entry_problems()).select("seq", F.array_join("problems", ", ").alias("problems"))


LISTING_SQL = f"""WITH {OBS_SQL}, d AS (SELECT repo, ref, make_timestamp(us)::DATE AS day, arg_max(commit_no, (us, event_id)) AS c FROM obs WHERE outcome = 'ok' GROUP BY 1, 2, 3),
ls AS (SELECT repo, day, epoch_us(day::TIMESTAMP) AS us, row_number() OVER (PARTITION BY repo ORDER BY day) AS n FROM (SELECT DISTINCT repo, day FROM d)),
p AS (SELECT d.repo, d.ref, ls.n, ls.us, c, lag(n) OVER w AS pn, lag(us) OVER w AS pus, lag(c) OVER w AS pc, lead(n) OVER w AS nn FROM d JOIN ls ON d.repo = ls.repo AND d.day = ls.day WINDOW w AS (PARTITION BY d.repo, d.ref ORDER BY n)),
mx AS (SELECT repo, max(n) AS last_n FROM ls GROUP BY 1),
g AS (SELECT p.repo, p.ref, p.c, p.nn, ls.us FROM p JOIN mx ON mx.repo = p.repo JOIN ls ON ls.repo = p.repo AND ls.n = p.n + 1 WHERE p.n < last_n AND (nn IS NULL OR nn > p.n + 1))
SELECT repo, us, 'move' AS event, ref, pc AS from_commit, c AS to_commit, ((us - pus) // 1000000)::BIGINT AS seconds FROM p WHERE pn = n - 1 AND pc <> c
UNION ALL SELECT repo, us, 'deletion', ref, c, c, NULL FROM g
UNION ALL SELECT g.repo, p.us, 'recreation', g.ref, g.c, p.c, ((p.us - g.us) // 1000000)::BIGINT FROM g JOIN p ON p.repo = g.repo AND p.ref = g.ref AND p.n = g.nn"""


def daily_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per repository and day: what its references were last bound to."""
    last = ledger.latest(by_day(spark, sf_dir).select("repo", "ref", "day", "us", "event_id", "commit_no"), ["repo", "ref", "day"], ORDER)
    pairs = F.array_sort(F.collect_list(F.struct("ref", "commit_no")))
    rows = last.groupBy("repo", "day").agg(pairs.alias("r"))
    return rows.select("repo", F.unix_micros(F.col("day").cast("timestamp")).alias("us"), F.col("r.ref").alias("names"), F.col("r.commit_no").alias("commits"))


@query(LISTING_SQL)
def q45_listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.changes(daily_listings(spark, sf_dir))


@query(LISTING_SQL)
def q44_stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes from a stream with state, fed week by week."""
    folder = shared.folder(spark, "replay")
    rows = daily_listings(spark, sf_dir).withColumn("week", F.floor(F.col("us") / (7 * DAY)))
    rows.repartition("week").write.partitionBy("week").parquet(f"{folder}/all")
    for k in sorted(r[0] for r in spark.read.parquet(f"{folder}/all").select("week").distinct().collect()):  # a few batches of a replay, one file each
        spark.read.parquet(f"{folder}/all/week={k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("repo long, us long, names array<string>, commits array<long>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return changes.replay(stream, folder)


@query("""SELECT coalesce(event, '*') AS event, coalesce(form, '*') AS form, n FROM (SELECT event_type AS event, CASE WHEN user_id % 3 = 0 THEN 'exact' ELSE 'floating' END AS form, count(*) AS n FROM events GROUP BY CUBE (1, 2))""")
def q46_event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over events and forms with all subtotals."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.when(F.col("user_id") % 3 == 0, "exact").otherwise("floating").alias("form"))
    return e.cube("event", "form").agg(F.count("*").alias("n")).select(F.coalesce("event", F.lit("*")).alias("event"), F.coalesce("form", F.lit("*")).alias("form"), "n")


@query(f"""WITH ev AS ({LISTING_SQL}), nm AS (SELECT *, regexp_replace(ref, '^refs/tags/', '') AS b, CASE WHEN from_commit = to_commit THEN 'release_level_only' WHEN from_commit // 2 = to_commit // 2 THEN 'commit_metadata_only' ELSE 'content_change' END AS kind FROM ev),
f AS (SELECT *, {FORM_SQL} AS form, NULL AS ancestry, false AS correlated FROM nm)
SELECT repo::VARCHAR AS repo, ref, event, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.000Z') AS recorded_at, form AS ref_form,
  CASE event WHEN 'move' THEN kind WHEN 'recreation' THEN CASE WHEN from_commit = to_commit THEN 'release_level_only' ELSE 'content_change' END ELSE 'content_change' END AS classification,
  CASE event WHEN 'deletion' THEN 'info' WHEN 'recreation' THEN CASE WHEN from_commit = to_commit THEN 'info' ELSE 'medium' END ELSE {SEVERITY_SQL} END AS severity,
  CASE event WHEN 'recreation' THEN seconds END AS gap_seconds, CASE event WHEN 'move' THEN seconds END AS observation_window_seconds, from_commit::VARCHAR AS from_target, to_commit::VARCHAR AS to_target,
  CASE WHEN event = 'move' AND from_commit < to_commit THEN to_commit - from_commit END AS files_added
FROM f""")
def q48_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the changes between listings, with the diffs that are known."""
    c = F.col
    bound = lambda side: F.struct(c(f"{side}_commit").cast("string").alias("commit_sha"), c(f"{side}_commit").cast("string").alias("target_sha"))
    e = listings.changes(daily_listings(spark, sf_dir)).withColumn("ref_form", refs.ref_form(c("ref")))
    e = e.withColumn("kind", classify.move_kind(c("from_commit"), c("to_commit"), F.floor(c("from_commit") / 2), F.floor(c("to_commit") / 2)))
    moved = classify.severity(c("ref_form"), c("kind"), F.lit(None).cast("string"), F.lit(False))
    severity = F.when(c("event") == "deletion", "info").when(c("event") == "recreation", listings.severity_of_recreation(c("from_commit"), c("to_commit"))).otherwise(moved)
    e = e.select(c("repo").cast("string").alias("repo"), "ref", "event", "kind", "ref_form", severity.alias("severity"), times.wire(F.timestamp_micros("us")).alias("recorded_at"), F.when(c("event") == "recreation", c("seconds")).alias("gap_seconds"), F.when(c("event") == "move", c("seconds")).alias("observation_window_seconds"), bound("from").alias("from"), bound("to").alias("to"))
    pairs = inline(spark, [(a, b) for a in range(4) for b in range(a + 1, 4)], "a long, b long")
    empty = spark.createDataFrame([], schemas.ENTRY).schema["diff"].dataType
    known = {"diff_possibly_truncated": F.lit(False), "files_added": c("b") - c("a")}
    diffs = pairs.select(c("a").cast("string").alias("old_sha"), c("b").cast("string").alias("new_sha"), F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty]).alias("diff"))
    made = entries.entries(e.withColumns({s: padded(e, s) for s in ("from", "to")}), diffs)
    return made.select("repo", "ref", "event", "recorded_at", "ref_form", "classification", "severity", "gap_seconds", "observation_window_seconds", c("from.target_sha").alias("from_target"), c("to.target_sha").alias("to_target"), c("diff.files_added").alias("files_added"))


def padded(rows: DataFrame, side: str) -> Column:
    """A binding with all fields of its schema, those that it lacks null."""
    whole = rows.sparkSession.createDataFrame([], schemas.ENTRY).schema[side].dataType
    have = rows.schema[side].dataType.names
    return F.struct(*[(F.col(f"{side}.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole])


CHAINS_SQL = """WITH RECURSIVE t AS (SELECT o_orderkey AS sha, o_orderkey // 2 AS next_sha, CASE WHEN o_orderkey = 1 THEN 'tag' WHEN o_orderkey % 11 = 0 THEN 'commit' WHEN o_orderkey % 13 = 0 THEN 'tree' WHEN o_orderkey % 17 = 0 THEN 'note' ELSE 'tag' END AS next_kind
  FROM (SELECT DISTINCT greatest(o_orderkey, 1) AS o_orderkey FROM orders WHERE o_orderkey % 19 <> 7)),
tt AS (SELECT sha, CASE WHEN sha = 1 THEN 1 ELSE next_sha END AS next_sha, next_kind FROM t),
r AS (SELECT sha AS tip, next_sha AS cur, next_kind AS kind, 1::BIGINT AS hops FROM tt UNION ALL
  SELECT r.tip, tt.next_sha, tt.next_kind, r.hops + 1 FROM r JOIN tt ON tt.sha = r.cur WHERE r.kind = 'tag' AND r.hops < 40),
e AS (SELECT r.*, max(hops) OVER (PARTITION BY tip) AS top FROM r),
x AS (SELECT tip, cur, CASE WHEN kind = 'tag' AND hops >= 40 THEN 'cycle' WHEN kind = 'tag' THEN 'missing' ELSE kind END AS kind, hops FROM e WHERE hops = top),
p AS (SELECT o_orderkey AS tip, CASE WHEN o_orderkey % 23 = 0 THEN 'commit' ELSE 'tag' END AS tip_kind FROM orders)
SELECT p.tip AS sha, CASE WHEN reason IS NULL THEN cur END AS peeled_sha, CASE WHEN reason IS NULL THEN kind END AS peeled_kind, CASE WHEN reason IS NULL THEN hops END AS hops, reason FROM (
  SELECT p.tip, CASE WHEN tip_kind = 'tag' THEN cur ELSE p.tip END AS cur, CASE WHEN tip_kind <> 'tag' THEN tip_kind ELSE coalesce(kind, 'missing') END AS kind, CASE WHEN tip_kind = 'tag' THEN coalesce(hops, 0) ELSE 0 END AS hops,
    CASE WHEN tip_kind <> 'tag' THEN NULL WHEN kind = 'cycle' THEN 'cycle' WHEN coalesce(kind, 'missing') = 'missing' AND coalesce(hops, 0) < 8 THEN 'missing object' WHEN hops > 8 OR kind = 'missing' THEN 'too deep' WHEN kind NOT IN ('commit', 'tree', 'blob') THEN 'unsupported kind' END AS reason
  FROM p LEFT JOIN x ON x.tip = p.tip) p"""


@query(CHAINS_SQL)
def q53_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of tags end, or why they don't: each order points to the one of half its number."""
    c, key = F.col, F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    kind = F.when(key == 1, "tag").when(key % 11 == 0, "commit").when(key % 13 == 0, "tree").when(key % 17 == 0, "note").otherwise("tag")
    tags = orders.where(key % 19 != 7).select(F.greatest(key, F.lit(1)).alias("o_orderkey")).distinct()
    tags = tags.select(key.alias("sha"), F.when(key == 1, 1).otherwise(F.floor(key / 2)).cast("long").alias("next_sha"), kind.alias("next_kind"))
    tips = orders.select(key.alias("sha"), F.when(key % 23 == 0, "commit").otherwise("tag").alias("kind"))
    return objects.peeled(tips, tags).select("sha", "peeled_sha", "peeled_kind", c("hops").cast("long").alias("hops"), "reason")


RECOVERY_SQL = f"""WITH ev AS ({LISTING_SQL}), st AS (SELECT min(us) + {14 * DAY} AS stop FROM ev), tip AS (SELECT max(us) AS tip FROM ev, st WHERE us <= stop),
early AS (SELECT min(us) AS us FROM ev, tip WHERE repo = 5 AND us > tip)
SELECT ev.repo::VARCHAR AS repo, ev.us, event, ref, from_commit, to_commit, seconds, 'o' || ev.repo::VARCHAR || '-' || ev.us::VARCHAR AS observation_id FROM ev, tip WHERE us > tip AND NOT (repo = 5 AND us = (SELECT us FROM early))"""


@query(RECOVERY_SQL)
def q54_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger that stops after two weeks has missed; one later listing is named by a row of it, and failed polls say nothing."""
    c, slug = F.col, F.col("repo").cast("string")
    named = F.concat(F.lit("o"), slug, F.lit("-"), c("us").cast("string"))
    listed = daily_listings(spark, sf_dir).select(slug.alias("repo"), "us", "names", "commits", named.alias("observation_id"), times.wire(F.timestamp_micros("us")).alias("observed_at"), F.struct(F.lit("ok").alias("type")).alias("outcome"))
    failed = listed.select("repo", (c("us") + HOUR).alias("us"), F.array().cast("array<string>").alias("names"), F.array().cast("array<long>").alias("commits"), F.concat(F.lit("x"), "observation_id").alias("observation_id"), times.wire(F.timestamp_micros(c("us") + HOUR)).alias("observed_at"), F.struct(F.lit("failed").alias("type")).alias("outcome"))
    all_changes = shared.stage(listings.changes(listed.select("repo", "us", "names", "commits")), "changes")
    stop = all_changes.agg((F.min("us") + 14 * DAY).alias("stop"))
    kept = all_changes.join(F.broadcast(stop)).where("us <= stop")
    tip = kept.agg(F.max("us").alias("tip"))
    early = all_changes.where("repo = '5'").join(F.broadcast(tip)).where("us > tip").agg(F.min("us").alias("us"), F.max("tip").alias("tip"))
    rows = kept.select("event", times.wire(F.timestamp_micros("us")).alias("recorded_at"), F.array(named).alias("source_observations"))
    released = early.select(F.lit("move").alias("event"), times.wire(F.timestamp_micros("tip")).alias("recorded_at"), F.array(F.concat(F.lit("o5-"), c("us").cast("string"))).alias("source_observations"))
    other = kept.select(F.lit("correlation").alias("event"), times.wire(F.timestamp_micros("us")).alias("recorded_at"), F.array(F.concat(F.lit("o"), slug, F.lit("-"), (c("us") + 20 * DAY).cast("string"))).alias("source_observations"))
    found = entries.recovered(listed.unionByName(failed), rows.unionByName(released).unionByName(other))
    return found.select("repo", "us", "event", "ref", "from_commit", "to_commit", "seconds", "observation_id")


@query(BATCH_SQL + """, g AS (SELECT repo, batch_id, max(us // 1000) AS at FROM bt GROUP BY 1, 2),
u AS (SELECT DISTINCT g.repo, g.batch_id, g.at, unnest(arg_max(members, us)) AS ref FROM bt JOIN g USING (repo, batch_id) GROUP BY g.repo, g.batch_id, g.at),
s AS (SELECT u.repo, u.batch_id, u.ref, max(mv.event_id) AS seq FROM u JOIN mv ON mv.repo = u.repo AND mv.ref = u.ref AND mv.us // 1000 <= u.at GROUP BY 1, 2, 3)
SELECT repo::VARCHAR AS repo, batch_id, array_to_string(list_sort(list(DISTINCT seq)), ',') AS member_seqs, array_to_string(list_sort(list(ref)), ',') AS refs FROM s GROUP BY 1, 2""")
def q55_correlation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of batches, whose members are the last rows of their references up to the batch."""
    at = lambda: times.wire(F.timestamp_micros("us")).alias("recorded_at")
    rows = moved(spark, sf_dir).select(F.lit("move").alias("event"), F.col("repo").cast("string").alias("repo"), "ref", at(), F.col("event_id").alias("seq"))
    b = batched(spark, sf_dir).select(F.col("repo").cast("string").alias("repo"), at(), "batch_id", F.col("members").alias("refs"), F.lit(True).alias("all_to_same_target"), F.lit(None).cast("string").alias("note"))
    made = entries.correlations(b, rows).select("repo", "correlation.*")
    return made.select("repo", "batch_id", F.array_join(F.transform("member_seqs", lambda x: x.cast("string")), ",").alias("member_seqs"), F.array_join("refs_moved_together", ",").alias("refs"))


CACHE_SQL = f"""WITH {OBS_SQL}, n AS (SELECT commit_no::VARCHAR || '-' || repo::VARCHAR AS c, CASE WHEN k % 31 = 0 THEN commit_no::VARCHAR || '-' || repo::VARCHAR WHEN k % 29 = 0 THEN repeat('0', 39) || '2' WHEN k % 37 = 0 THEN '' ELSE 't' || (tree_no + (k % 23 = 0)::INTEGER)::VARCHAR END AS t, us, event_id, ref FROM obs WHERE outcome = 'ok'),
g AS (SELECT * FROM n WHERE t <> '' AND t <> c AND t <> repeat('0', 39) || '2'),
m AS (SELECT c, arg_min(t, (us, event_id)) AS kept FROM g WHERE c <> '3-7' GROUP BY c)"""


def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and the trees that observations give for them, some not to be trusted and some that differ."""
    o, c = ok(spark, sf_dir), F.col
    sha = F.concat_ws("-", c("commit_no").cast("string"), c("repo").cast("string"))
    tree = F.when(c("k") % 31 == 0, sha).when(c("k") % 29 == 0, F.lit(objects.PLACEHOLDERS[1])).when(c("k") % 37 == 0, "").otherwise(F.concat(F.lit("t"), (c("tree_no") + (c("k") % 23 == 0).cast("int")).cast("string")))
    return o.select(F.lit("commit").alias("kind"), sha.alias("commit_sha"), tree.alias("tree_sha"), "us", "event_id", "ref")


def tree_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index merged in two appends, and all trusted rows; one commit is never cached."""
    rows = tree_rows(spark, sf_dir).where("commit_sha <> '3-7'")
    rows = rows.where(objects.trusted_tree(F.col("commit_sha"), F.col("tree_sha")))
    half = rows.agg(F.expr("min(us) + (max(us) - min(us)) / 2").alias("_half"))
    early = rows.join(F.broadcast(half)).where("us < _half").drop("_half")
    late = rows.join(F.broadcast(half)).where("us >= _half").drop("_half")
    first = shared.stage(objects.tree_index(early, ORDER), "trees")
    return shared.stage(objects.merge(first, late, "commit_sha", "tree_sha", ORDER), "trees"), rows


@query(CACHE_SQL + " SELECT m.c AS commit_sha, kept, t AS other, count(*) AS n FROM m JOIN g ON g.c = m.c WHERE t <> kept GROUP BY 1, 2, 3")
def q56_tree_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that observations give for a commit whose first trusted tree is another."""
    index, rows = tree_table(spark, sf_dir)
    return objects.conflicts(index, rows, "commit_sha", "tree_sha")


@query(CACHE_SQL + """ SELECT n.event_id, n.c AS commit_sha, n.t AS before, coalesce(kept, n.t) AS tree_sha, NOT (g.event_id IS NOT NULL AND coalesce(n.t = kept, false)) AS unverified_before,
  kept IS NULL AS unverified_after FROM n LEFT JOIN m ON m.c = n.c LEFT JOIN g ON g.event_id = n.event_id""")
def q57_tree_healing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings with the trees of the index, and which were and are not verified."""
    index, _ = tree_table(spark, sf_dir)
    return objects.healed(tree_rows(spark, sf_dir).select("event_id", "commit_sha", "tree_sha"), index).select("event_id", "commit_sha", "before", "tree_sha", "unverified_before", "unverified_after")


WHOLE_SQL = f"""WITH {OBS_SQL}, d AS (SELECT repo, ref, make_timestamp(us)::DATE AS day, arg_max(commit_no, (us, event_id)) AS c FROM obs WHERE outcome = 'ok' GROUP BY 1, 2, 3),
ls AS (SELECT *, row_number() OVER v AS n, lead(us) OVER v AS nus FROM (SELECT DISTINCT repo, epoch_us(day::TIMESTAMP) AS us FROM d) WINDOW v AS (PARTITION BY repo ORDER BY us)),
p AS (SELECT d.repo, d.ref, c, ls.n, ls.us, ls.nus, lag(ls.n) OVER w AS pn, lag(ls.us) OVER w AS pus, lag(ls.nus) OVER w AS gone, lag(c) OVER w AS pc, lead(ls.n) OVER w AS nn FROM d JOIN ls ON ls.repo = d.repo AND ls.us = epoch_us(d.day::TIMESTAMP) WINDOW w AS (PARTITION BY d.repo, d.ref ORDER BY ls.n)),
s AS (SELECT *, sum((pn IS NULL OR (pn = n - 1 AND pc <> c))::INTEGER) OVER (PARTITION BY repo, ref ORDER BY n) AS b FROM p),
y AS (SELECT *, min(us) OVER z AS f, count(*) OVER z AS k FROM s WINDOW z AS (PARTITION BY repo, ref, b ORDER BY n)),
z AS (SELECT *, lag(f) OVER w AS pf, lag(k) OVER w AS pk FROM y WINDOW w AS (PARTITION BY repo, ref ORDER BY n)),
ev AS (SELECT repo, ref, us, 'move' AS event, pc AS a, c AS t, pf AS af, pus AS al, pk AS ak, f AS tf, us AS tl, k AS tk, us - pus AS win, NULL AS gap, pus AS s1, us AS s2 FROM z WHERE pn = n - 1 AND pc <> c
  UNION ALL SELECT repo, ref, us, 'recreation', pc, c, pf, pus, pk, f, us, k, us - pus, us - gone, pus, us FROM z WHERE pn < n - 1
  UNION ALL SELECT repo, ref, nus, 'deletion', c, c, f, us, k, nus, nus, 0, nus - us, NULL, us, nus FROM z WHERE nus IS NOT NULL AND (nn IS NULL OR nn > n + 1)),
nm AS (SELECT *, regexp_replace(ref, '^refs/tags/', '') AS b, CASE WHEN a = t THEN 'release_level_only' WHEN a // 2 = t // 2 THEN 'commit_metadata_only' ELSE 'content_change' END AS kind, NULL AS ancestry, false AS correlated FROM ev),
fm AS (SELECT *, {FORM_SQL} AS form FROM nm),
en AS (SELECT repo::VARCHAR AS repo, ref, event, us, form AS ref_form, CASE event WHEN 'move' THEN kind WHEN 'recreation' THEN CASE WHEN a = t THEN 'release_level_only' ELSE 'content_change' END ELSE 'content_change' END AS classification,
  CASE event WHEN 'deletion' THEN 'info' WHEN 'recreation' THEN CASE WHEN a = t THEN 'info' ELSE 'medium' END ELSE {SEVERITY_SQL} END AS severity, (win // 1000000)::BIGINT AS window_seconds, (gap // 1000000)::BIGINT AS gap_seconds,
  ak AS from_count, ((al - af) // 86400000000)::BIGINT AS from_days, tk AS to_count, ((tl - tf) // 86400000000)::BIGINT AS to_days, 'o' || repo::VARCHAR || '-' || s1::VARCHAR || ',' || 'o' || repo::VARCHAR || '-' || s2::VARCHAR AS sources FROM fm),
dg AS (SELECT strftime(make_timestamp(us)::DATE, '%Y-%m-%d') AS date, count(DISTINCT repo) AS ok, string_agg(DISTINCT strftime(make_timestamp(us), '%Y/%m/%d/') || 'acme--r' || repo::VARCHAR || '.jsonl', ',' ORDER BY strftime(make_timestamp(us), '%Y/%m/%d/') || 'acme--r' || repo::VARCHAR || '.jsonl') AS files FROM obs WHERE outcome = 'ok' GROUP BY 1),
nt AS (SELECT date, string_agg(note, '; ' ORDER BY note) AS note FROM (SELECT note, min(date) AS date FROM (SELECT 'late r' || (repo % 4)::VARCHAR AS note, strftime(make_timestamp(us)::DATE, '%Y-%m-%d') AS date FROM obs WHERE outcome = 'failed') GROUP BY note) GROUP BY date),
al AS (SELECT *, 1 AS rank, NULL AS date, NULL AS files, NULL AS note FROM en UNION ALL BY NAME SELECT epoch_us(dg.date::DATE::TIMESTAMP + INTERVAL 1 DAY) AS us, 'observation_digest' AS event, ok::BIGINT AS to_count, 0 AS rank, dg.date, files, note FROM dg LEFT JOIN nt ON nt.date = dg.date)
SELECT row_number() OVER (ORDER BY us, rank, CASE event WHEN 'deletion' THEN 0 WHEN 'recreation' THEN 1 ELSE 2 END, repo, ref) - 1 AS seq, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.000Z') AS recorded_at, event, repo, ref, ref_form, classification, severity, window_seconds, gap_seconds, from_count, from_days, to_count, to_days, sources, date, files, note, '' AS problems FROM al"""


@query(WHOLE_SQL)
def q58_verified_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From listings to a linked ledger with daily digests, and what verification finds in each of its rows (nothing)."""
    c = F.col
    listed = daily_listings(spark, sf_dir).withColumn("observation_id", F.concat(F.lit("o"), c("repo").cast("string"), F.lit("-"), c("us").cast("string")))
    rows = entries.of_listings(listings.bound_events(listed), lambda commit: F.floor(commit / 2))
    o = observations(spark, sf_dir)
    date = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("date")
    good = o.where("outcome = 'ok'").select(date, "repo", F.concat(F.date_format(F.timestamp_micros("us"), "yyyy/MM/dd/"), F.lit("acme--r"), c("repo").cast("string"), F.lit(".jsonl")).alias("path"))
    days = good.groupBy("date").agg(F.count_distinct("repo").alias("repos_polled")).select("date", "repos_polled", c("repos_polled").alias("ok"), *[F.lit(0).cast("long").alias(x) for x in ("not_modified", "failed", "skipped")])
    files = good.select("date", "path").distinct().withColumn("sha256", canonical.sha256_ref(c("path")))
    notes = o.where("outcome = 'failed'").select(date, F.concat(F.lit("late r"), (c("repo") % 4).cast("string")).alias("note"))
    made = rows.unionByName(entries.digests(days, files, notes))
    order = {"_rank": (c("event") != "observation_digest").cast("int"), "_kind": entries.event_rank(c("event"))}
    linked = shared.stage(ledger.link(made.withColumns(order), ["recorded_at", "_rank", "_kind", "repo", "ref"], drop=list(order)), "linked")
    bad = ledger.violations(linked).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("what")), ", ").alias("problems"))
    digest = c("observation_digest")
    out = linked.join(bad, "seq", "left")
    return out.select("seq", "recorded_at", "event", "repo", "ref", "ref_form", "classification", "severity", c("observation_window_seconds").alias("window_seconds"), "gap_seconds", c("from.observation_count").alias("from_count"), c("from.stable_days").alias("from_days"), F.coalesce(c("to.observation_count"), digest["ok"]).alias("to_count"), c("to.stable_days").alias("to_days"), F.array_join("source_observations", ",").alias("sources"), digest["date"].alias("date"), F.array_join(digest["files"]["path"], ",").alias("files"), digest["note"].alias("note"), F.coalesce("problems", F.lit("")).alias("problems"))


PLAN_SQL = f"""WITH {OBS_SQL}, s AS (SELECT user_id AS repo, ref, arg_max(commit_no, us) AS target, min(us) AS first_us, count(*) AS n, max(k) AS k FROM obs WHERE outcome = 'ok' GROUP BY 1, 2),
st AS (SELECT *, k % 7 = 0 AS tombstoned, CASE WHEN k % 3 > 0 THEN k % 4 END AS prior_target, CASE WHEN k % 5 > 0 THEN n % 4 END AS bound_target, CASE WHEN k % 5 > 0 THEN n % 11 END AS bound_commit, CASE WHEN k % 5 > 0 THEN n % 11 + (k % 2) END AS bound_tree, CASE WHEN k % 4 = 0 THEN n % 4 END AS pending_to FROM s),
w AS (SELECT *, CASE WHEN tombstoned THEN 'recreated' WHEN coalesce(prior_target, bound_target) <> target THEN 'moved' WHEN pending_to = target THEN 'pending' END AS why FROM st),
p AS (SELECT *, CASE WHEN why <> 'recreated' THEN CASE WHEN bound_target IS NULL THEN prior_target WHEN bound_tree = bound_commit AND bound_commit NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0) THEN bound_commit END END AS prior_sha FROM w WHERE why IS NOT NULL),
b AS (SELECT repo, ref, target, why, prior_sha, sum(1 + (prior_sha IS NOT NULL)::INTEGER) OVER (ORDER BY CASE why WHEN 'recreated' THEN 0 WHEN 'moved' THEN 1 ELSE 2 END, repo, ref) AS spent FROM p)
SELECT repo, ref, target, why, prior_sha::BIGINT AS prior_sha, spent::BIGINT AS spent FROM b WHERE spent <= (SELECT count(*) // 50 FROM events)"""


@query(PLAN_SQL)
def q59_peel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which references to resolve first, by why and name, as far as the budget goes; an old object costs one more."""
    o, c = observations(spark, sf_dir), F.col
    s = o.where("outcome = 'ok'").groupBy(c("user_id").alias("repo"), "ref").agg(F.max_by("commit_no", "us").alias("target"), F.count("*").alias("n"), F.max("k").alias("k"))
    bound = lambda x: F.when(c("k") % 5 > 0, x)
    state = s.select("repo", "ref", (c("k") % 7 == 0).alias("tombstoned"), F.when(c("k") % 3 > 0, c("k") % 4).cast("long").alias("prior_target"), bound(c("n") % 4).alias("bound_target"), bound(c("n") % 11).alias("bound_commit"), bound(c("n") % 11 + c("k") % 2).alias("bound_tree"), F.when(c("k") % 4 == 0, c("n") % 4).alias("pending_to"))
    index = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(c("n_nationkey").cast("long").alias("commit_sha"))
    plan = population.priority_peels(s.select("repo", "ref", "target"), state, index)
    plan = plan.withColumn("cost", F.lit(1).cast("long") + c("prior_sha").isNotNull().cast("int"))
    rank = F.when(c("why") == "recreated", 0).when(c("why") == "moved", 1).otherwise(2)
    return population.within_budget(plan, [rank, c("repo"), c("ref")], "cost", o.count() // 50).drop("cost")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_suppkey * 7 % 100 + l_linenumber % 2 AS dst FROM lineitem),
r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1),
pr AS (SELECT d.node, d.depth, min(e.src) AS parent FROM d JOIN e ON e.dst = d.node JOIN d q ON q.node = e.src AND q.depth = d.depth - 1 GROUP BY 1, 2),
w AS (SELECT node, depth, parent, node::VARCHAR AS path FROM pr WHERE node % 3 = 0 UNION ALL SELECT w.node, w.depth, pr.parent, w.parent::VARCHAR || '>' || w.path FROM w JOIN pr ON pr.node = w.parent)
SELECT node, depth, '1>' || path AS path FROM w WHERE parent = 1""")
def q60_unpinned_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which chain each node that isn't pinned is reached from the first one."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") * 7 % 100 + F.col("l_linenumber") % 2).alias("dst"))
    found = population.closure_with_paths(inline(spark, [(1,)], "node long"), edges, 6)
    return found.where("node % 3 = 0 and depth > 0").select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH {OBS_SQL}, q AS (SELECT event_id, repo, ref, us, CASE outcome WHEN 'ok' THEN 200 WHEN 'not_modified' THEN 304 ELSE 500 END AS status FROM obs),
s AS (SELECT *, max(CASE WHEN status = 200 THEN us END) OVER (PARTITION BY repo, ref ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored_at FROM q)
SELECT event_id, stored_at, CASE WHEN stored_at IS NULL THEN 'first' WHEN us - stored_at > {2 * DAY} THEN 'refresh' ELSE 'conditional' END AS mode FROM s""")
def q61_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each poll is sent: what is stored may be two days old at most, and only a full answer renews it."""
    status = F.when(F.col("outcome") == "ok", 200).when(F.col("outcome") == "not_modified", 304).otherwise(500)
    return bindings.freshness(observations(spark, sf_dir), KEY, ORDER, "us", status, 2 * DAY).select("event_id", "stored_at", "mode")


DAMAGES = ("none", "row", "head", "file", "note", "age")


@query("""WITH n AS (SELECT count(*) AS n FROM nation), d AS (SELECT unnest(['none', 'row', 'head', 'file', 'note', 'age']) AS damage)
SELECT damage, n + 1 AS entries, 0::BIGINT AS first_seq, n AS last_seq, CASE damage WHEN 'row' THEN 'rows' WHEN 'head' THEN 'heads' WHEN 'file' THEN 'files' WHEN 'none' THEN NULL ELSE 'strict' END AS stage,
  CASE damage WHEN 'row' THEN 3 WHEN 'head' THEN n WHEN 'file' THEN n WHEN 'note' THEN n WHEN 'age' THEN 0 END AS bad_seq,
  CASE damage WHEN 'row' THEN 'hash mismatch' WHEN 'head' THEN 'head of another hash' WHEN 'file' THEN 'changed file a/b.jsonl' WHEN 'note' THEN 'note of a backlog' WHEN 'age' THEN 'no head for too long' END AS failure FROM n, d""")
def q62_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for each kind of damage to a ledger: which stage finds it first, where and what."""
    c = F.col
    kinds = spark.createDataFrame([], schemas.ENTRY).schema
    own = {"event": F.lit("correction"), "format_version": F.lit(1), "corrects_seq": F.lit(0).cast("long"), "reason": c("n_name"), "recorded_at": F.concat(F.lit("2026-01-01T00:00:"), F.lpad(c("n_nationkey").cast("string"), 2, "0"), F.lit(".000Z"))}
    rows = table(spark, sf_dir, "nation").select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds if f.name not in entries.LINKS])

    def made(note: str) -> DataFrame:
        days = inline(spark, [("2026-01-03", 1, 1, 0, 0, 0)], "date string, repos_polled long, ok long, not_modified long, failed long, skipped long")
        digest = entries.digests(days, inline(spark, [("2026-01-03", "a/b.jsonl", "sha256:" + "a" * 64)], "date string, path string, sha256 string"), inline(spark, [("2026-01-03", note)], "date string, note string"))
        return shared.stage(ledger.link(rows.unionByName(digest), ["recorded_at"]), "verdict")

    plain, noted = made("all is well"), made("a " + verify.BACKLOG)
    tip = plain.orderBy(c("seq").desc()).limit(1)
    head = lambda of, hash_=None: of.select(F.struct((hash_ if hash_ is not None else c("entry_hash")).alias("entry_hash"), "recorded_at", "seq").alias("head"), F.lit("s").alias("signature"))
    files = lambda x: inline(spark, [("a/b.jsonl", "sha256:" + x * 64)], "path string, sha256 string")
    bad_row = plain.withColumn("reason", F.when(c("seq") == 3, "changed").otherwise(c("reason")))
    cases = {"none": (plain, head(tip), files("a")), "row": (bad_row, head(tip, F.lit("x")), files("b")), "head": (plain, head(tip, F.lit("x")), files("b")), "file": (plain, head(tip), files("b")), "note": (noted, head(noted.orderBy(c("seq").desc()).limit(1)), files("a")), "age": (plain, head(tip).limit(0), files("a"))}
    out = None
    for damage in DAMAGES:
        one = verify.verdict(*cases[damage]).select(F.lit(damage).alias("damage"), "entries", "first_seq", "last_seq", "stage", "bad_seq", "failure")
        out = one if out is None else out.unionByName(one)
    return out


LINE_SQL = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus)"


@query(f"""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, {LINE_SQL} || chr(10) AS line FROM orders),
f AS (SELECT month, string_agg(line, '' ORDER BY o_orderkey) AS text FROM o GROUP BY 1)
SELECT month AS path, strlen(text)::BIGINT AS bytes, 'sha256:' || sha256(text) AS sha256, month[-2:]::INTEGER % 4 <> 0 AS appended FROM f""")
def q63_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published files of a month's orders each: size and hash, and whether the next version only appends to it."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, sf_dir, "orders").select(month.alias("month"), F.col("o_orderkey").alias("k"), F.concat_ws(",", *[F.col(x).cast("string") for x in ("o_orderkey", "o_custkey", "o_orderstatus")]).alias("value"))
    nth = F.substring("month", 6, 2).cast("int") % 12
    # the next version: new lines at the end; of some months the last line changed, or lines gone, or no file
    # the next version: a line more at the end; of some months the last line changed, or gone, or no file
    ended = rows.withColumn("_last", F.col("k") == F.max("k").over(Window.partitionBy("month"))).where((nth != 0) & ~((nth == 8) & F.col("_last")))
    value = F.when((nth == 4) & F.col("_last"), F.lit("changed")).otherwise(F.col("value"))
    # a union of lines and last lines could keep both sides' partitions, which makes two files of a month
    after = F.when(F.col("_last"), F.array(value, F.lit("one more"))).otherwise(F.array(value))
    next_ = ended.select("month", "k", F.posexplode(after).alias("n", "value"))
    old, new = shared.folder(spark, "published"), shared.folder(spark, "published-next")
    for path, made in ((old, rows.withColumn("n", F.lit(0))), (new, next_)):
        made.repartition("month").sortWithinPartitions("month", "k", "n").select("month", "value").write.partitionBy("month").text(path)
    # a month is one file, which the month names in both versions
    named = lambda path: F.regexp_extract(path, "month=([^/]+)", 1)
    bad = published.not_appended(spark, old, new, named).withColumn("_bad", F.lit(True))
    return published.digests(spark, old, named).join(bad, "path", "left").select("path", "bytes", "sha256", F.col("_bad").isNull().alias("appended"))
