"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table, whole_row, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def hash_uniform(seed: str, *keys: Column) -> Column:
    """A uniform number in (0, 1) from 52 bits of an MD5; the same on any partitioning and in DuckDB."""
    joined = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def source_targets(sized: DataFrame, source_col: str = "source", size_col: str = "size", weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """One row per source (null is one too): ``source_size``, ``weight``, ``target``.

    Sources by code point, null last, take the weights in turn and share the size of all. A target
    stops at ``cap`` times its source's size; the excess is shared out again by weight. With the
    sources sorted by cap / weight, the level at which that ends is one running sum away: those
    whose cap / weight is at most the level stay at their cap, the rest get level x weight.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    per = sized.groupBy(source_col).agg(F.sum(size_col).alias("source_size"))
    per = per.withColumn("_n", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    most = F.col("source_size") * cap
    by_ratio = Window.orderBy("_ratio", "_n")
    per = per.withColumn("_ratio", most / F.col("weight"))
    per = per.select(
        "*",
        F.sum("source_size").over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
        F.coalesce(F.sum(most).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_used"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("_left"),
    )
    per = per.withColumn("_level", (F.col("_all") - F.col("_used")).cast("double") / F.col("_left"))
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.least(most.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select(source_col, "source_size", "weight", "target")


def inclusion(sized: DataFrame, targets: DataFrame, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """One row per source (null is one too): ``_source``, ``source_size``, ``target``, ``copies`` (certain
    whole copies of every document), ``_budget`` (words missing after them) and ``_rate``.

    A document of n words is in the sample for the missing words with probability min(1, rate x n), so
    longer ones are likelier, and the rate makes the words expected meet the budget. With sizes from the
    largest down, the documents that are certain are those above some size: for each size, the rate that
    holds if all larger ones are certain follows from two running sums, and the largest size that
    this rate leaves uncertain decides. The windows run over one row per source and size.
    """
    # Of the whole words of the target, so that what is left is always less than the source has.
    whole = F.round("target").cast("long")
    here = targets.select(F.col(source_col).alias("_source"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("copies"))
    here = here.withColumn("_budget", whole - F.col("copies") * F.col("source_size"))
    per = sized.where(F.col(size_col) > 0).groupBy(F.col(source_col).alias("_s"), F.col(size_col).alias("_n")).agg(F.count(F.lit(1)).alias("_k"))
    wide = lambda c: F.col(c).cast("decimal(12,0)")  # noqa: E731  squares of very long texts pass 64 bits
    larger = Window.partitionBy("_s").orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_s").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("_s", "_n", F.coalesce(F.sum(F.col("_n") * F.col("_k")).over(larger), F.lit(0)).alias("_certain"), F.sum(wide("_n") * wide("_n") * wide("_k")).over(upto).alias("_square"))
    per = per.join(here.select("_source", "_budget"), F.col("_s").eqNullSafe(F.col("_source")))
    rate = (F.col("_budget") - F.col("_certain")).cast("double") / F.col("_square").cast("double")
    rates = per.where(rate * F.col("_n") < 1).groupBy("_s").agg(F.max_by(rate, "_n").alias("_rate"))
    return here.join(rates, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "source_size", "target", "copies", "_budget", F.when(F.col("_budget") > 0, F.coalesce("_rate", F.lit(0.0))).otherwise(F.lit(0.0)).alias("_rate"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where p is 0 (never) or 1 (certain)."""
    return F.when((p > 0) & (p < 1), (u / (1.0 - u)) / (p / (1.0 - p)))


def pareto_mix(sized: DataFrame, targets: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", rows_per_bin: int = 20_000) -> DataFrame:
    """How much of each document the mix takes: adds ``copies`` (certain whole copies),
    ``extra`` (words of one copy more) and ``taken``; columns of these names and ``source_size``, ``target``,
    ``weight`` are replaced, all others kept, whatever their names.

    A document is expected r = target / source_size times by words. Its floor(r) whole copies are certain;
    the rest is a Pareto sample of unequal probabilities p (``inclusion``): with a uniform u from the id,
    documents are ranked by (u / (1 - u)) / (p / (1 - p)), then id, after those with p = 1, and the
    first ones are taken until the words missing to the target are there. The document at the end
    of the budget gives only the words that are still missing, so each source meets its target to
    the word.

    A source is never gathered in one task: ranks are cut into bins of a size that is bounded by
    ``rows_per_bin`` on average, bin totals (one row per source and bin) are summed in order, and
    only rows of one bin are sorted together. Null sources form a source, null ids count as "",
    rows with the same id and size share their rank in no set order, null or zero sizes take 0,
    an empty table gives an empty result.
    """
    sized = sized.drop("copies", "extra", "taken", "source_size", "target", "weight")
    bins = max(256, sized.count() // rows_per_bin)
    here = settle(inclusion(sized, targets, source_col, size_col))
    rows = sized.select(whole_row(sized), F.col(id_col).alias("id"), F.col(source_col).alias("from"), F.col(size_col).alias("size_"), F.coalesce(F.col(size_col), F.lit(0)).alias("size"))
    ranked = rows.join(here, F.col("from").eqNullSafe(F.col("_source")), "left")
    size, p = F.col("size"), F.least(F.lit(1.0), F.col("_rate") * F.col("size"))
    ranked = ranked.withColumn("_u", hash_uniform(seed, F.col("id"))).withColumn("_p", p).withColumn("_q", pareto_rank(F.col("_u"), F.col("_p")))
    mean = F.try_divide("_budget", "source_size")  # ranks times the odds of a mean document are spread evenly enough
    x = F.col("_q") * mean / (1.0 - mean)
    bin_ = F.when(F.col("_p") >= 1, -1 - F.floor(F.col("_u") * bins)).otherwise(F.coalesce(F.floor(x / (1.0 + x) * bins), F.floor(F.col("_u") * bins)))
    ranked = ranked.withColumn("_bin", bin_)
    per_bin = ranked.groupBy("_source", "_bin").agg(F.sum("size").alias("_in_bin"))
    ahead = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.select(F.col("_source").alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_in_bin").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_source", "_bin").orderBy("_q", "id", "size_").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.join(per_bin, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")), "left")
    ranked = ranked.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("_ahead"))
    extra = F.when(F.col("_p") >= 1, size).when(F.col("_p") > 0, F.greatest(F.lit(0), F.least(size, F.col("_budget") - F.col("_before")))).otherwise(F.lit(0)).cast("long")
    ranked = ranked.withColumn("extra", extra).withColumn("taken", F.col("copies") * size + F.col("extra"))
    return ranked.select("row.*", "source_size", "target", "copies", "extra", "taken")


def mix_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as the mix takes it, whole.

    A document of which the sample takes half or more is taken whole once more, others are not, so a
    source meets its target to half a document. Per source this is one cut in the order of the ranks,
    and each row is held against it where it is read: texts, however long, are not shuffled. A
    document without words is not taken; null sources are one source, null ids count as ""; rows that
    repeat an id share its fate. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    sized = settle(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_from"), word_count(F.col(text_col)).alias("size")))
    targets = settle(source_targets(sized, "_from"))
    here = settle(inclusion(sized, targets, "_from"))
    own = lambda i, q: F.struct(q.alias("q"), F.coalesce(i.cast("string"), F.lit("")).alias("i"))
    odds = lambda i, n: pareto_rank(hash_uniform(seed, i), F.least(F.lit(1.0), F.col("_rate") * n))
    taken = pareto_mix(sized, targets, seed, "_id", "_from").where("extra * 2 >= size AND size > 0").select("_id", "_from", "size")
    taken = taken.join(F.broadcast(here), F.col("_from").eqNullSafe(F.col("_source")))  # one row per source
    q = odds(F.col("_id"), F.col("size"))
    cut = taken.where(q.isNotNull()).groupBy(F.col("_source").alias("_s")).agg(F.max(own(F.col("_id"), q)).alias("_cut"))
    rule = settle(here.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "copies", "_rate", "_cut"))
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.col(source_col).alias("from"), word_count(F.col(text_col)).alias("n"))
    rows = rows.join(F.broadcast(rule), F.col("from").eqNullSafe(F.col("_source")))  # one row per source
    rows = rows.withColumn("_q", odds(F.col("id"), F.col("n")))
    once_more = (F.col("_rate") * F.col("n") >= 1) | F.coalesce(own(F.col("id"), F.col("_q")) <= F.col("_cut"), F.lit(False)) & F.col("_q").isNotNull()
    times = F.when(F.col("n") > 0, (F.col("copies") + once_more.cast("int")).cast("int")).otherwise(F.lit(0))
    return rows.withColumn("_each", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return pareto_mix(sized, settle(source_targets(sized))).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, (source_size * 3)::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM r
), t AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, coalesce(max(CASE WHEN ratio > lvl THEN lvl END) OVER (), 0::DOUBLE) * weight) AS target FROM l
), c AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS BIGINT) AS copies FROM t
), k AS (
  SELECT *, CAST(round(target) AS BIGINT) - copies * source_size AS budget FROM c
), z AS (
  SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL
), y AS (
  SELECT source, size, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
    sum(size * size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS square FROM z
), x AS (
  SELECT y.source, y.size, (budget - certain)::DOUBLE / square::DOUBLE AS rate FROM y JOIN k ON y.source IS NOT DISTINCT FROM k.source
), g AS (
  SELECT source, arg_max(rate, size) AS rate FROM x WHERE rate * size < 1 GROUP BY source
), u AS (
  SELECT d.doc_id, d.size, k.*, least(1.0::DOUBLE, CASE WHEN budget > 0 THEN coalesce(g.rate, 0.0::DOUBLE) ELSE 0.0::DOUBLE END * d.size) AS p,
    (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p >= 1 THEN -1 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 'infinity'::DOUBLE END, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM u
)
SELECT doc_id, size, source_size, target, CAST(copies * size + CASE WHEN p >= 1 THEN size WHEN p > 0 THEN greatest(0, least(size, budget - ahead)) ELSE 0 END AS BIGINT) AS taken FROM o
"""

QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": OP2_SQL}
