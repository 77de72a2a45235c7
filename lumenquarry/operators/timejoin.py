"""Joins over ordered values (J2 to J4, W1): windows and bucketed equi-joins, no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, at: str, time: str, reach: float, by: list[str]) -> DataFrame:
    """Rows of right with |time - at| <= reach for each row of left, both of one group.

    Both sides get the number of a bucket of the width 2 * reach; a row of left looks into the two buckets its window
    touches, so the join is on equal keys.
    """
    width = 2 * reach
    near = left.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col(at) - reach) / width), F.floor((F.col(at) + reach) / width)))))
    far = right.withColumn("_bucket", F.floor(F.col(time) / width))
    return near.join(far, [*by, "_bucket"]).where(F.abs(F.col(time) - F.col(at)) <= reach).drop("_bucket")


def window_counts(df: DataFrame, by: list[str], time: str, reach: int, value: str) -> DataFrame:
    """J2 within one table: the rows of the group within reach of each row, and their mean value."""
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-reach, reach)
    return df.withColumns({"near": F.count("*").over(w), "near_mean": F.avg(value).over(w)})


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, key: str, right_key: str) -> DataFrame:
    """For each row of left the nearest row of right in time, the earlier one on a tie, then the least right_key.

    The union sorted by group and time, forward and back: the last right row before and the first one after each left row compete.
    """
    of_left = left.select(*by, F.col(time).alias("_t"), F.col(key).alias("_key"), F.lit(None).cast("struct<t:bigint,id:bigint>").alias("_r"))
    first = right.groupBy(*by, F.col(time).alias("_t")).agg(F.min(right_key).alias("_id"))
    of_right = first.select(*by, "_t", F.lit(None).cast("bigint").alias("_key"), F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")).alias("_r"))
    both = of_left.unionByName(of_right)
    w = Window.partitionBy(*by)
    before = F.last("_r", True).over(w.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("_r", True).over(w.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0))  # a growing frame
    rows = both.withColumns({"_b": before, "_a": after}).where(F.col("_key").isNotNull())
    earlier = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t")))
    best = F.when(earlier, F.col("_b")).otherwise(F.col("_a"))
    return rows.select(F.col("_key").alias(key), *by, best["id"].alias(right_key), F.abs(best["t"] - F.col("_t")).alias("gap")).where(F.col(right_key).isNotNull())


def best_ahead(df: DataFrame, by: list[str], order: list[str], ahead: int, score: Column, key: str, fits: Column | None = None) -> DataFrame:
    """For each row the best of the next `ahead` rows of its group by score; the nearer one on ties.

    score and fits read the row as `a` and the other as `b`. The next rows are taken from a bounded frame, so no join.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(F.struct(*df.columns).alias("a"), F.collect_list(F.struct(*df.columns)).over(w.rowsBetween(1, ahead)).alias("_next"))
    if fits is None:
        fits = F.lit(True)
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("a", "_row", F.posexplode("_next").alias("place", "b")).where(fits)
    each = each.select("_row", F.struct(score.alias("score"), (-F.col("place")).alias("near"), F.col(f"a.{key}").alias("key"), F.col(f"b.{key}").alias("other")).alias("_x"))
    # a row's candidates stand side by side, so the maximum is complete before the shuffle and one row each is sent
    return each.groupBy("_row").agg(F.max("_x").alias("_x")).select(F.col("_x.key").alias(key), "_x.other", "_x.score")
