"""Ranks and order statistics without a group in one task: counts by value, running sums over stretches of the value range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A group's value range is cut into STRETCH^2 equal stretches, which are summed up STRETCH at a time.
STRETCH = 256
#: Copies of a group's ends, so that a large group's values don't meet them in one task.
SALTS = 32


def numbered(rows: DataFrame, within: Sequence[str], *levels: Sequence[str], name: str = "nth") -> DataFrame:
    """Rows with their number from 1 in order of all ``levels`` within each ``within``.

    Rows are counted at each level but the last; a running sum over a level's
    counts says what comes before each of its groups. So only the rows of one
    group are ever ranked together, and the counts of one group a level up.
    """
    keys = [*within, *(k for level in levels[:-1] for k in level)]
    ranked = rows.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*levels[-1])))
    if len(levels) == 1:
        return ranked.withColumnRenamed("r_", name)
    sums = running(rows.groupBy(*keys).agg(F.count("*").alias("n_")), within, levels[:-1], "n_")
    return ranked.join(sums.select(*keys, "before"), keys).withColumn(name, F.col("r_") + F.col("before")).drop("r_", "before")


def running(counts: DataFrame, within: Sequence[str], levels: Sequence[Sequence[str]], n: str) -> DataFrame:
    """``counts`` with ``before``, the sum of ``n`` over the rows ahead in order of all levels, and ``total``."""
    upper = [*within, *levels[0]]
    top = counts.groupBy(*upper).agg(F.sum(n).alias("s_"))
    group = Window.partitionBy(*within)
    ahead = lambda by, order, k: F.coalesce(F.sum(k).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if len(levels) == 1:
        return counts.withColumns({"before": ahead(within, levels[0], n), "total": F.sum(n).over(group)})
    top = top.select(*upper, ahead(within, levels[0], "s_").alias("up_"), F.sum("s_").over(group).alias("total"))
    lower = running(counts, upper, levels[1:], n).drop("total")
    return lower.join(top, upper).withColumn("before", F.col("before") + F.col("up_")).drop("up_")


def ranked_values(rows: DataFrame, by: Sequence[str], value: str, finer: Sequence[str] = (), count: Column | None = None) -> DataFrame:
    """One row for each distinct value (and ``finer`` key) of each group: ``n``, ``before`` (rows ahead in order of value, then finer keys) and ``total``.

    Equal values are counted before any shuffle. A group's values are cut into
    stretches of its range, so that a window holds the distinct values of one
    stretch. Rows count one each, or ``count``.
    """
    counts = rows.groupBy(*by, value, *finer).agg((F.count("*") if count is None else F.sum(count)).alias("n"))
    ends = counts.groupBy(*by).agg(F.min(value).cast("double").alias("lo_"), F.max(value).cast("double").alias("hi_"))
    ends = ends.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wide = F.col("hi_") - F.col("lo_")
    # correctly rounded steps keep the order of the values, so stretches follow it
    place = F.floor((F.col(value).cast("double") - F.col("lo_")) / wide * (STRETCH * STRETCH))
    stretch = F.when((wide > 0) & (wide < float("inf")) & ~F.isnan(wide), F.least(F.greatest(place, F.lit(0)), F.lit(STRETCH * STRETCH - 1))).otherwise(F.lit(0))
    cut = counts.withColumn("salt_", F.pmod(F.xxhash64(value, *finer), F.lit(SALTS)).cast("int")).join(ends, [*by, "salt_"])
    cut = cut.withColumn("fine_", stretch).withColumn("coarse_", F.floor(F.col("fine_") / STRETCH)).drop("salt_", "lo_", "hi_")
    levels = [["coarse_"], ["fine_"], [value], *[[k] for k in finer]]
    return running(cut, list(by), levels, "n").drop("coarse_", "fine_")


def nearest_ranks(rows: DataFrame, by: Sequence[str], value: str, count: Column | None = None, **ranks) -> DataFrame:
    """Per group ``n`` and the values at the given ranks; each rank is a function of the column ``n`` that gives a place from 0."""
    v = ranked_values(rows, by, value, count=count)
    at = lambda rank: (F.col("before") <= rank(F.col("total"))) & (F.col("before") + F.col("n") > rank(F.col("total")))
    return v.groupBy(*by).agg(F.sum("n").alias("n"), *[F.max(F.when(at(rank), F.col(value))).alias(name) for name, rank in ranks.items()])


def median_rank(n: Column) -> Column:
    return F.floor(n / 2)


def p99_rank(n: Column) -> Column:
    return F.least(n - 1, F.floor(n * 0.99))
