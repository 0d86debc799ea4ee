"""Stories over time: growth, stage of life, priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def half_growth(daily: DataFrame, group: str, day: str, n: str) -> DataFrame:
    """Percent by which the second half of a group's daily series exceeds the first; 100 for series under four days."""
    w = Window.partitionBy(group)
    rows = daily.withColumn("i", F.row_number().over(w.orderBy(day))).withColumn("days", F.count(F.lit(1)).over(w))
    first = F.sum(F.when(F.col("i") <= F.floor(F.col("days") / 2), F.col(n)).otherwise(0))
    second = F.sum(F.when(F.col("i") > F.floor(F.col("days") / 2), F.col(n)).otherwise(0))
    out = rows.groupBy(group).agg(F.max("days").alias("days"), first.alias("first"), second.alias("second"))
    return out.select(group, "days", F.when(F.col("days") < 4, 100.0).otherwise(F.round((F.col("second") - F.col("first")) * 100.0 / F.greatest("first", F.lit(1)), 1)).alias("growth"))


def lifecycle(daily: DataFrame, group: str, day: str, n: str) -> DataFrame:
    """Stage of each group's daily series, from where its peak lies, what follows, and whether it rises again."""
    w = Window.partitionBy(group)
    rows = daily.select(group, day, F.col(n).alias("n"), (F.row_number().over(w.orderBy(day)) - 1).alias("i"), F.lag(n).over(w.orderBy(day)).alias("before"))
    ends = rows.groupBy(group).agg(
        F.min(F.struct((-F.col("n")).alias("m"), "i", day)).alias("top"),
        F.min(F.when(F.col("n") > 0, F.col("i"))).alias("first"),
        F.max(F.when(F.col("n") > 0, F.col("i"))).alias("last"),
        F.min_by("n", "i").alias("start_n"),
        F.max_by("n", "i").alias("end_n"),
    )
    again = rows.join(ends.select(group, F.col("top.i").alias("peak")), group).groupBy(group).agg(F.bool_or((F.col("i") >= F.col("peak") + 2) & (F.col("n") > F.col("before"))).alias("again"))
    out = ends.join(again, group).withColumns({"peak": F.col("top.i"), "peak_n": -F.col("top.m"), "first": F.coalesce("first", F.lit(0)), "last": F.coalesce("last", F.lit(0))})
    down = (F.col("peak") < F.col("last")) & (F.col("end_n") < F.col("peak_n"))
    stage = (
        F.when(down & F.col("again"), "recurrencia").when(down, "descenso").when((F.col("peak") == F.col("last")) & (F.col("end_n") > F.col("start_n")), "crecimiento")
        .when(F.col("peak") == F.col("last"), "pico").when(F.col("last") - F.col("first") >= 3, "propagacion").otherwise("aparicion")
    )
    return out.select(group, stage.alias("stage"), F.col(f"top.{day}").alias("peak_day"))


def chunks(rows: DataFrame, group: str, order: list, most: int = 5) -> DataFrame:
    """Adds chunk: up to `most` stretches of equal size in order; what is left over goes to the last. For groups that fit a task; see time_chunks."""
    w = Window.partitionBy(group)
    n, parts = F.count(F.lit(1)).over(w), F.least(F.lit(most), F.count(F.lit(1)).over(w))
    i = F.row_number().over(w.orderBy(*order)) - 1
    return rows.withColumn("chunk", F.least(F.floor(i / F.floor(n / parts)), parts - 1).cast("bigint") + 1)


def time_chunks(rows: DataFrame, group: str, at: str, key: str, most: int = 5) -> DataFrame:
    """Adds chunk: up to `most` stretches of equal size in order of time and key; what is left over goes to the last.

    Hours of a group are counted first, so that rows are numbered inside their hour alone and a group of a third of all rows is no one task's.
    """
    hour = F.date_trunc("hour", at)
    n = rows.groupBy(group, hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    start = n.select(group, "hour", (F.sum("n").over(w.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("start"), F.sum("n").over(w).alias("total"))
    placed = rows.withColumn("hour", hour).withColumn("i", F.row_number().over(Window.partitionBy(group, "hour").orderBy(at, key)))
    placed = placed.join(start, [group, "hour"])
    parts = F.least(F.lit(most), F.col("total"))
    turn = F.least(F.floor((F.col("start") + F.col("i") - 1) / F.floor(F.col("total") / parts)), parts - 1).cast("bigint") + 1
    return placed.withColumn("chunk", turn).drop("hour", "i", "start", "total")
