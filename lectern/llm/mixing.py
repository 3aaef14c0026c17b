"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Each source gets a target number of words; a document of it is expected ``target / words of the source`` times.
Within a source the documents stand in the order of their size (then of a hash, then of their id); the running sum of
expected copies plus one offset per source is cut at the integers, and a document is emitted once for every integer
that its step crosses. As neighbours in that order are of like size, the words taken differ from the target by about
the largest document at most.

The running sum needs each document's rank within its source, although one source may hold a third of all rows. It is
put together from three short sums, none of which brings a source into one task: size classes within the source, slices
of a hash within the class, and rows within the slice.

Defined results: a null text has size 0; a null source is a source of its own, the last; sources of no words get the
target 0 and no copies; rows that repeat an id are rows like any other; an empty table gives an empty result; columns
of any name pass through unchanged in mixed_documents().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._shared import WORD, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix-1"
#: Leading decimal digits of a size that tell its class: classes differ by 1 % at most, and there are some 900 a decade.
CLASS_DIGITS = 3

_KEY = ["__no_source", "__source"]


def _sized(docs: DataFrame, payload: Column, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    row = docs.select(
        payload.alias("__row"), F.col("doc_id").alias("__id"), F.col("source").isNull().alias("__no_source"),
        F.coalesce(F.col("source"), F.lit("")).alias("__source"), size.alias("__size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("__hash"),
    )
    step = F.pow(F.lit(10.0), F.greatest(F.length(F.col("__size").cast("string")) - CLASS_DIGITS, F.lit(0))).cast("long")
    return row.withColumn("__class", F.col("__size") - F.col("__size") % step).withColumn("__slice", F.substring("__hash", 1, 2))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """One row per source, from rows (key, __words): its target, rate and offset.

    Sharing by weight with the excess of full sources reshared ends where every target is the smaller of its cap and one
    common level times its weight. Among sources ordered by cap / weight, the level left to the k-th and later ones
    rises while sources fill up and falls afterwards, so that it is the largest of these.
    There is one row per source here, so the windows over all of them are short.
    """
    order, full = W.orderBy(*_KEY), W.orderBy("__ratio", *_KEY)
    n = len(weights)
    every = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__weight", F.element_at(every, ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    capped = ranked.withColumn("__cap", F.lit(float(most)) * F.col("__words")).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    filled = F.coalesce(F.sum("__cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("__weight").over(full.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("__words").over(W.partitionBy()).cast("double")
    level = capped.withColumn("__level", (F.lit(float(share)) * everything - filled) / open_weight)
    target = F.least(F.col("__cap"), F.max("__level").over(W.partitionBy()) * F.col("__weight"))
    name = F.when(F.col("__no_source"), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("__source")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":offset"), name).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return level.select(
        *_KEY, F.col("__words").alias("__source_size"), target.alias("__target"), start.alias("__start"),
        F.when(F.col("__words") > 0, target / F.col("__words")).otherwise(F.lit(0.0)).alias("__rate"),
    )


def _copies(rows: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """rows with __source_size, __target and __copies."""
    slices = rows.groupBy(*_KEY, "__class", "__slice").agg(F.count("*").alias("__n"), F.sum("__size").alias("__words"))
    slices = stored(slices, "mix-slices")
    classes = slices.groupBy(*_KEY, "__class").agg(F.sum("__n").alias("__n"), F.sum("__words").alias("__words"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("__n").over(before.partitionBy(*_KEY).orderBy("__class")), F.lit(0))
    targets = source_targets(classes.groupBy(*_KEY).agg(F.sum("__words").alias("__words")), weights, share, most, seed)
    places = classes.select(*_KEY, "__class", earlier.alias("__before_class")).join(targets, _KEY)
    within = F.coalesce(F.sum("__n").over(before.partitionBy(*_KEY, "__class").orderBy("__slice")), F.lit(0))
    starts = (
        slices.select(*_KEY, "__class", "__slice", within.alias("__before_slice"))
        .join(places, [*_KEY, "__class"])
        .select(*_KEY, "__class", "__slice", (F.col("__before_class") + F.col("__before_slice")).alias("__before"), "__source_size", "__target", "__start", "__rate")
    )
    at = W.partitionBy(*_KEY, "__class", "__slice").orderBy("__hash", "__id")
    ranked = rows.withColumn("__rank", F.row_number().over(at)).join(starts, [*_KEY, "__class", "__slice"])
    rank = (F.col("__before") + F.col("__rank")).cast("double")
    crossed = F.floor(rank * F.col("__rate") + F.col("__start")) - F.floor((rank - 1) * F.col("__rate") + F.col("__start"))
    return ranked.withColumn("__copies", crossed.cast("long"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), copies and taken (copies times size)."""
    rows = stored(_sized(docs, F.lit(None).cast("int"), seed).drop("__row"), "mix-sizes")
    return _copies(rows, weights, share, most, seed).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is emitted, with their own columns."""
    rows = _copies(_sized(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]), seed), weights, share, most, seed)
    emitted = rows.filter(F.col("__copies") > 0).select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return emitted.select("__row.*")


#: DuckDB's form of mix_plan over documents.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
classed AS (
  SELECT *, size - size % CAST(pow(10, greatest(length(CAST(size AS VARCHAR)) - 3, 0)) AS BIGINT) AS cls FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source),
weighed AS (
  SELECT source, words, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sources),
capped AS (
  SELECT *, 2.0::DOUBLE * words AS cap, 2.0::DOUBLE * words / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(words) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
targets AS (
  SELECT source, words, least(cap, max(level) OVER () * weight) AS target,
         CAST(('0x' || substr(md5('mix-1:offset' || coalesce('=' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start
  FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, h, doc_id)::DOUBLE AS rank FROM classed),
cut AS (
  SELECT r.doc_id, r.size, t.words AS source_size, t.target, r.rank, t.start,
         CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0 END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(rank * rate + start) - floor((rank - 1) * rate + start) AS BIGINT) AS copies,
       CAST(floor(rank * rate + start) - floor((rank - 1) * rate + start) AS BIGINT) * size AS taken
FROM cut
"""
