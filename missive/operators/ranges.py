"""Running sums and ranks in two levels, so that no task sees a whole column in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.sources.scratch import written

#: Ranges of an ordered column; as many bounds at most reach the driver.
RANGES = 200


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of the range that a row's value of a numeric or time column is in, by approximate quantiles."""
    numbers = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    bounds = sorted(set(numbers.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.002)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column).cast("double")))


def before(df: DataFrame, column: str, sums: list[str], descending: bool = False) -> DataFrame:
    """df, one row for each value of column, with before_<name>: the sum of <name> over the rows ahead.

    Sums of the ranges give each range its offset; only rows of one range are ordered together. df is written
    once, since quantiles, sums and rows read it.
    """
    df = written(df)
    rows = df.withColumn("__range", range_of(df, column))
    order = lambda c: F.desc(c) if descending else F.asc(c)
    per = rows.groupBy("__range").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    ahead = Window.orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = per.select("__range", *[F.coalesce(F.sum(f"__{s}").over(ahead), F.lit(0)).alias(f"__{s}") for s in sums])
    inside = Window.partitionBy("__range").orderBy(order(column)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), "__range")
    return reduce(lambda d, s: d.withColumn(f"before_{s}", F.col(f"__{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))), sums, out).drop("__range", *[f"__{s}" for s in sums])


def hash_ranked(df: DataFrame, strata: list[str], order: Column, key: str) -> DataFrame:
    """df with __rank (from 1) by order, then key, within its stratum, and __n, the rows of the stratum.

    order is hexadecimal text: its first four digits are counted first, and only rows that
    share them are ordered together.
    """
    rows = df.withColumns({"__s": F.to_json(F.struct(*strata)), "__h": order}).withColumn("__bin", F.substring("__h", 1, 4))
    sizes = rows.groupBy("__s", "__bin").agg(F.count(F.lit(1)).alias("__m"))
    ahead = Window.partitionBy("__s").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    sizes = sizes.withColumns({"__ahead": F.coalesce(F.sum("__m").over(ahead), F.lit(0)), "__n": F.sum("__m").over(Window.partitionBy("__s"))}).drop("__m")
    inside = F.row_number().over(Window.partitionBy("__s", "__bin").orderBy("__h", key))
    return rows.join(sizes, ["__s", "__bin"]).withColumn("__rank", F.col("__ahead") + inside).drop("__s", "__bin", "__h", "__ahead")
