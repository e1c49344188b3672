"""Joins of points with intervals, and nearest-rank percentiles, without a shuffle that sees all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with the intervals [low, high) that hold them: an equi-join on cells of ``width``, then the exact test.

    An interval is repeated once per cell it touches, so choose the width near the intervals' usual length.
    """
    p = points.withColumn("__cell", F.floor(F.col(point) / width))
    i = intervals.filter(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(i, "__cell").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")


def nearest_rank(df: DataFrame, by: list[str], value: Column, points: dict[str, float], width: int = 65_536) -> DataFrame:
    """``n``, ``min``, ``max``, ``mean`` and nearest-rank percentiles of an integer value per group, exactly.

    Equal values are counted before the shuffle, and the counts summed up by bins of ``width`` values; running totals of the bins, of
    which a group has few, say in which bin a rank lies, and only the values of those bins are ranked. So no task sees all values
    of a group. Null values are left out; a null in ``by`` is a group.
    """
    counts = df.select(*by, value.alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__bin", F.floor(F.col("__v") / width))
    bins = counts.groupBy(*by, "__bin").agg(F.sum("__n").alias("__bn"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum(F.col("__v") * F.col("__n")).alias("__s"))
    w = Window.partitionBy(*by)
    run = bins.withColumn("__before", F.coalesce(F.sum("__bn").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__t", F.sum("__bn").over(w))
    asked = run.withColumn("__q", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in points.items()])))
    asked = asked.withColumn("__need", F.greatest(F.ceil(F.col("__t") * F.col("__q.q")), F.lit(1)) - F.col("__before")).filter(F.col("__need").between(1, F.col("__bn")))
    asked = asked.select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], F.col("__bin").alias("__in"), F.col("__q.name").alias("__name"), "__need")
    same = lambda left, right: [left[c].eqNullSafe(right[f"__by_{i}"]) for i, c in enumerate(by)]
    near = counts.join(asked, [*same(counts, asked), counts["__bin"] == asked["__in"]])
    near = near.withColumn("__c", F.sum("__n").over(Window.partitionBy(*by, "__bin", "__name").orderBy("__v"))).filter("__c >= __need")
    at = near.groupBy(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)]).agg(*[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in points])
    whole = bins.groupBy(*by).agg(F.sum("__bn").alias("n"), F.min("__lo").alias("min"), F.max("__hi").alias("max"), (F.sum("__s") / F.sum("__bn")).alias("mean"))
    return whole.join(at, same(whole, at)).select(*by, "n", "min", "max", "mean", *points)
