"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

A source's target divided by its size gives the expected copies of each of its words. The whole part
of that is allocated to every document for certain. What remains of the target goes by unequal
inclusion probabilities: a document's is proportional to its words, odds * size, where odds makes the
expected words of the sample equal to what remains; documents for which that is 1 or more are in for
certain and the factor is that of the others. These are ranked by the odds of a random number over the
odds of inclusion, q = (u / (1 - u)) / (pi / (1 - pi)), and taken in that order until the remaining
words are spent: a sample of fixed size in words. What is then left of the target is filled by the one
document that comes closest to it, if that helps.

u comes from the md5 of the seed and the id, so reruns agree. Ranks are found without sorting a
source in one task: words are summed by source and slice of q, the slice in which the target is
reached is found from these sums, and only that slice is sorted. The factor is found from counts by source and size. The sources themselves
are one row each and are put in order in one task: a table of thousands, not of documents.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own,
last in order; rows that repeat an id share one decision; an empty table gives an empty result;
other columns are ignored (and kept by ``mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES, SLICES, SEED = 1.5, 2, 4096, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number inside (0, 1) from 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), uniform(F.col("doc_id")).alias("u"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, target; one row per source.

    Weights go to the sources by code point. Where a weighted share is over MOST_COPIES times the
    source, it stops there and the excess is shared again by weight: sources in order of their limit
    over their weight reach it one after another, so running sums in that order give the level at
    which the rest end.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (k + 1).cast("int")).cast("long"))
        .withColumn("_limit", F.col("source_size") * MOST_COPIES)
        .withColumn("_all", F.sum("source_size").over(everywhere))
        .withColumn("_level", (F.col("_all").cast("double") * share - F.coalesce(F.sum("_limit").over(before), F.lit(0)).cast("double")) / F.sum("_w").over(rest).cast("double"))
        .withColumn("_level", F.first(F.when(F.col("_limit").cast("double") > F.col("_level") * F.col("_w").cast("double"), F.col("_level")), ignorenulls=True).over(everywhere))
        .withColumn("target", F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level") * F.col("_w").cast("double"), F.col("_limit").cast("double"))))
        .select("source", "source_size", "target")
    )


def factors(sizes: DataFrame, open_: DataFrame) -> DataFrame:
    """source, odds and sure: a document of size s is in for certain if s > sure, else with odds * s.

    With the sizes from the largest down, the factor of those not yet certain follows from the words
    of the larger ones; the largest size at which it gives less than 1 is the first that isn't certain.
    """
    counts = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = counts.join(open_, counts["source"].eqNullSafe(open_["source"])).drop(open_["source"])
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy("size")
    squares = F.sum(F.col("n").cast("double") * F.col("size").cast("double") * F.col("size").cast("double")).over(others)
    above = F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0)).cast("double")
    found = counts.withColumn("odds", (F.col("rest") - above) / squares).where("odds * size < 1")
    return found.groupBy("source").agg(F.max_by("odds", "size").alias("odds"), F.max("size").alias("sure"))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """What decides every document's copies, one row per source."""
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = stage(
        targets(sizes, weights, share)
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")),
        "shares",
    )
    factor = factors(sizes, shares.where("rest > 0").select("source", "rest"))
    by_source = stage(shares.join(factor, same(shares, factor), "left").drop(factor["source"]), "sources")
    open_ = by_source.where("rest > 0").select("source", "rest", "odds", "sure")
    ranked = with_rank(sizes.join(open_, same(sizes, open_)).drop(open_["source"])).where("q is not null")
    ranked = stage(ranked.select("source", "doc_id", "size", "rest", "q", "slice"), "ranked")
    sums = ranked.groupBy("source", "slice").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    sums = sums.withColumn("through", F.sum("n").over(Window.partitionBy("source").orderBy("slice")))
    edge = sums.where("through > rest").groupBy("source").agg(F.min(F.struct("slice", (F.col("through") - F.col("n")).alias("before"))).alias("e")).select("source", F.col("e.slice").alias("edge"), F.col("e.before").alias("before"))
    edge = stage(edge, "edges")
    inside = ranked.join(edge, same(ranked, edge) & (ranked["slice"] == edge["edge"])).drop(edge["source"])
    # rows that tie in q and id stand or fall together: the default frame sums over peers
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first())))
    last = inside.where("sum <= rest").groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("last"), F.max("sum").alias("spent"))
    cut = edge.join(last, edge["source"].eqNullSafe(last["source"]), "left").drop(last["source"]).withColumn("spent", F.coalesce("spent", "before"))
    cut = stage(cut.select("source", "edge", "last", "spent"), "cuts")
    out = ranked.join(cut, same(ranked, cut)).drop(cut["source"]).where(~inside_cut())
    out = out.withColumn("gap", F.abs(F.col("rest") - F.col("spent") - F.col("size"))).where("gap < rest - spent")
    closing = out.groupBy("source").agg(F.min(F.struct("gap", "q", "doc_id")).alias("c")).select("source", F.struct("c.q", "c.doc_id").alias("closing"))
    cut = cut.join(closing, same(cut, closing), "left").drop(closing["source"])
    decided = by_source.join(cut, same(by_source, cut), "left").drop(cut["source"])
    return stage(decided, "decided")  # a table of known size, which Spark broadcasts if it is small


def pareto(u: Column, pi: Column) -> Column:
    return (u / (1 - u)) / (pi / (1 - pi))


def with_rank(rows: DataFrame) -> DataFrame:
    """q and its slice for rows of sources with words to spend; those in for certain come before all others."""
    open_ = (F.col("rest") > 0) & (F.col("size") > 0)
    sure, pi = F.col("size") > F.col("sure"), F.col("odds") * F.col("size")
    rows = rows.withColumn("q", F.when(open_ & sure, F.lit(0.0)).when(open_ & (pi > 0), pareto(F.col("u"), pi)))
    return rows.withColumn("slice", F.when(open_ & sure, F.lit(-1)).otherwise(F.floor(F.col("q") / (1 + F.col("q")) * SLICES).cast("int")))


def inside_cut() -> Column:
    """Whether a row with q, slice and doc_id comes before its source's target is reached."""
    return (F.col("slice") < F.col("edge")) | ((F.col("slice") == F.col("edge")) & F.coalesce(F.struct("q", "doc_id") <= F.col("last"), F.lit(False)))


def copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows (source, doc_id, size, u) with source_size, target and the copies taken of each."""
    joined = rows.join(decided, rows["source"].eqNullSafe(decided["source"]), "left").drop(decided["source"])
    joined = with_rank(joined)
    extra = F.when(F.col("q").isNull(), F.lit(False)).when(F.col("edge").isNull(), F.lit(True)).otherwise(inside_cut() | F.coalesce(F.struct("q", "doc_id") == F.col("closing"), F.lit(False)))
    return joined.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)) + extra.cast("long")).drop("whole", "rest", "odds", "sure", "edge", "last", "spent", "closing", "q", "slice")


def op3(docs: DataFrame) -> DataFrame:
    sizes = stage(sized(docs), "sizes")
    return copies(sizes, plan(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, repeated ones more than once; texts are shuffled only if the sources are too many to broadcast."""
    sizes = stage(sized(docs), "sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"), uniform(F.col("doc_id")).alias("u"))
    taken = copies(rows, plan(sizes)).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def oracle_sql(documents: str = "documents") -> str:
    """The same selection for DuckDB, over the rows of a table or subquery with doc_id, source and text."""
    return f"""
WITH t AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE AS u
  FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 2 AS lim FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY lim::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM s1),
lv AS (SELECT arg_min(lv, (lim::DOUBLE / w::DOUBLE, source IS NULL, source)) AS lv FROM s2 WHERE lim::DOUBLE > lv * w::DOUBLE),
s3 AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(lv.lv * w::DOUBLE, lim::DOUBLE)) AS target FROM s2, lv),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM s3),
s5 AS (SELECT *, target - (whole * source_size)::DOUBLE AS rest FROM s4),
h0 AS (SELECT source, size, count(*) AS n FROM t WHERE size > 0 GROUP BY source, size),
h1 AS (SELECT h0.*, (rest - coalesce(sum(n * size) OVER (PARTITION BY h0.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(n::DOUBLE * size::DOUBLE * size::DOUBLE) OVER (PARTITION BY h0.source ORDER BY size) AS odds FROM h0 JOIN s5 ON h0.source IS NOT DISTINCT FROM s5.source WHERE rest > 0),
h2 AS (SELECT source, arg_max(odds, size) AS odds, max(size) AS sure FROM h1 WHERE odds * size < 1 GROUP BY source),
r0 AS (SELECT t.*, s5.* EXCLUDE (source), CASE WHEN NOT (rest > 0 AND t.size > 0) THEN NULL WHEN t.size > sure THEN 0 WHEN odds * t.size > 0 THEN (u / (1 - u)) / (odds * t.size / (1 - odds * t.size)) END AS q
  FROM t JOIN s5 ON t.source IS NOT DISTINCT FROM s5.source LEFT JOIN h2 ON t.source IS NOT DISTINCT FROM h2.source),
r1 AS (SELECT *, q IS NOT NULL AND sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST) <= rest AS picked FROM r0),
r2 AS (SELECT *, rest - coalesce(sum(CASE WHEN picked THEN size END) OVER (PARTITION BY source), 0)::DOUBLE AS gap FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN q IS NOT NULL AND NOT picked THEN 0 ELSE 1 END, abs(gap - size::DOUBLE), q, doc_id) AS nearest FROM r2)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN picked OR (q IS NOT NULL AND nearest = 1 AND abs(gap - size::DOUBLE) < gap) THEN 1 ELSE 0 END) AS taken
FROM r3
"""
