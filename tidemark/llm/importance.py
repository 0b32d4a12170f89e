"""Importance resampling of documents towards a target's distribution over hashed word n-grams.

Words are put into a dictionary of integers once; n-grams are tuples of these integers. The bytes of each
different tuple are put together again from the dictionary and hashed once, whatever its number of
occurrences, and the counts are joined back: by bucket into the gains, by tuple to the documents.

For single words (``most`` = 1) a tuple is its word, so the dictionary has the gain itself. It is joined in two
parts: a word with at least one in HOT of all occurrences is in a broadcast table, of at most HOT
rows for that reason; a document's other words go to the rest of the dictionary by a shuffle. So the
most frequent words, which are most of all occurrences, are never shuffled, and nothing that is broadcast
grows with the corpus. For longer n-grams the words' integers are put in order by windows within a document.

The draw: a document's score is its weight plus a Gumbel number from the id; the documents with enough words
and the highest scores are drawn. Ranks are the places in a range-partitioned sort, counted part by part.

Rows are told apart by their place in the table's files, so ``docs`` should be read from a table; stage
what comes out of a shuffle.

Defined cases: a null or empty text, or one without words, has no features and the weight 0; a null id hashes
as an empty one and comes last among ties; rows that repeat an id are scored and ranked each; an empty target
or an empty corpus counts as zeros; empty documents give an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import stage

#: The words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, as they are before it.
SPELLED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS, PERCENT, LEAST_WORDS, SEED, HOT = 10_000, 10, 20, "2024", 1 << 17


def lower(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def spelled(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPELLED), F.lit(0)), F.array().cast("array<string>"))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def dictionary(docs: DataFrame, target: DataFrame) -> DataFrame:
    """word (as spelled), id, n (in the documents), m (in the target) for every different word of both."""
    words = lambda df, n, m: df.select(F.explode(spelled(F.col("text"))).alias("word"), F.lit(n).alias("n"), F.lit(m).alias("m"))
    counted = words(docs, 1, 0).unionByName(words(target, 0, 1)).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return stage(counted.select("word", F.monotonically_increasing_id().alias("id"), "n", "m"), "dictionary")


def gains(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket, from features of bucket, n and m; at most so many rows."""
    by = features.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("m").alias("t"))
    every = features.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    totals = by.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    full = every.join(by, "bucket", "left").na.fill(0, ["s", "t"]).join(F.broadcast(totals))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return full.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def by_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())


def word_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, hot: int = HOT) -> DataFrame:
    """_row, doc_id, n_words, n_features and weight by single words."""
    words = dictionary(docs, target).withColumn("bucket", bucket(lower(F.col("word")), buckets))
    gained = stage(gains(words, buckets), "gains")
    words = stage(words.where("n > 0").join(F.broadcast(gained), "bucket").select("word", "n", "gain"), "word-gains")  # at most `buckets` rows
    total = words.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * hot >= total
    frequent = words.where(often).select(F.col("word").alias("_often"), F.col("gain").alias("_gain"))
    # each document has one null word more, for its row of frequent words, which alone carries the id
    each = by_row(docs).select("_row", "doc_id", F.explode(F.concat(spelled(F.col("text")), F.array(F.lit(None).cast("string")))).alias("word"))
    each = each.join(F.broadcast(frequent), F.col("word") == F.col("_often"), "left")  # at most `hot` rows
    seldom = F.when(F.col("_often").isNull(), F.col("word"))
    parts = each.groupBy("_row", seldom.alias("_word")).agg(F.count("word").alias("n"), F.sum("_gain").alias("_sum"), F.max(F.when(F.col("word").isNull(), F.col("doc_id"))).alias("doc_id"))
    parts = stage(parts, "word-parts")
    known = parts.where("_word is null").select("_row", "doc_id", "n", F.coalesce("_sum", F.lit(0)).alias("weight"))
    rest = parts.where("_word is not null").select("_row", "_word", "n").join(words.where(~often).select(F.col("word").alias("_word"), "gain"), "_word").groupBy("_row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gain")).alias("weight"))
    whole = known.unionByName(rest, allowMissingColumns=True).groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_words"), F.sum("weight").alias("weight"))
    return whole.withColumn("n_features", F.col("n_words"))


def tuples(rows: DataFrame, least: int, most: int) -> DataFrame:
    """_row and tuple (array of ids) of all runs of least to most consecutive words, from _row, pos and id."""
    w = Window.partitionBy("_row").orderBy("pos")
    ahead = rows.withColumns({f"_{k}": F.lead("id", k).over(w) for k in range(1, most)})
    runs = [F.when(F.col(f"_{n - 1}").isNotNull() if n > 1 else F.lit(True), F.array("id", *[F.col(f"_{k}") for k in range(1, n)])) for n in range(least, most + 1)]
    return ahead.select("_row", F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())).alias("tuple"))


def tuple_weights(docs: DataFrame, target: DataFrame, least: int, most: int, buckets: int = BUCKETS) -> DataFrame:
    """_row, doc_id, n_words, n_features and weight by n-grams of least to most words."""
    words = dictionary(docs, target)
    ids = words.select("word", "id")
    read = lambda df: df.select("_row", F.posexplode(spelled(F.col("text"))).alias("pos", "word")).join(ids, "word").select("_row", "pos", "id")
    rows = stage(by_row(docs), "rows")
    grams = stage(tuples(read(rows), least, most).groupBy("_row", "tuple").agg(F.count("*").alias("k")), "tuples")
    other = tuples(read(by_row(target.select(F.lit(None).alias("doc_id"), "text"))), least, most)
    counted = grams.groupBy("tuple").agg(F.sum("k").alias("n")).withColumn("m", F.lit(0)).unionByName(other.groupBy("tuple").agg(F.count("*").alias("m")).withColumn("n", F.lit(0)))
    counted = stage(counted.groupBy("tuple").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "tuple-counts")
    spelling = counted.select("tuple", F.posexplode("tuple").alias("pos", "id")).join(ids, "id").groupBy("tuple").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w"))
    text = lower(F.array_join(F.transform("_w", lambda x: x["word"]), " "))
    hashed = stage(spelling.select("tuple", bucket(text, buckets).alias("bucket")).join(counted, "tuple"), "tuple-buckets")
    gained = hashed.join(F.broadcast(stage(gains(hashed, buckets), "gains")), "bucket").select("tuple", "gain")  # at most `buckets` rows
    sums = grams.join(gained, "tuple").groupBy("_row").agg(F.sum("k").alias("n_features"), F.sum(F.col("k") * F.col("gain")).alias("weight"))
    sizes = rows.select("_row", "doc_id", F.size(spelled(F.col("text"))).cast("long").alias("n_words"))
    return sizes.join(sums, "_row", "left").na.fill(0, ["n_features", "weight"])


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first eight hex digits of the sha256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _rank from 1 in an order over the whole table, which no task sorts alone.

    A range-partitioned sort is written with each row's place in its part; the parts' sizes, one row a part,
    give where each begins.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(start), "_part").withColumn("_rank", F.col("_start") + place + 1).drop("_part", "_at", "_start")  # one row a part


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the rank of those not drawn is null."""
    weighed = word_weights(docs, target, buckets, hot) if most == 1 else tuple_weights(docs, target, least, most, buckets)
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    found = ranked(scored.where(enough), order).withColumn("rank", F.when(F.col("_rank") <= drawn, F.col("_rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return found.select(*columns).unionByName(scored.where(~enough).select(*columns[:4], F.lit(None).cast("long").alias("rank")))


#: crc32 by its table, which a rule gives: DuckDB has no such function.
ORACLE_SQL = f"""
WITH ct AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
dw AS (SELECT rn, unnest(ws) AS w FROM d),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
a AS (SELECT w, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m FROM (SELECT w, count(*) AS n, 0 AS m FROM dw GROUP BY w UNION ALL SELECT w, 0, count(*) FROM tw GROUP BY w) GROUP BY w),
b AS (SELECT w, n, m, (xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]))) % {BUCKETS})::INTEGER AS bucket FROM a, ct),
s AS (SELECT bucket, sum(n)::DOUBLE AS s, sum(m)::DOUBLE AS t FROM b GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE AS bs, sum(t)::DOUBLE AS bt FROM s),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (bs + {BUCKETS}) / ((s + 1) * (bt + {BUCKETS}))))::BIGINT AS gain FROM s, z),
x AS (SELECT rn, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY rn),
y AS (SELECT d.rn, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x ON x.rn = d.rn),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS enough FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * enough // 100 THEN place END AS rank FROM q"""
