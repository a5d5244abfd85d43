"""Statistics of query durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duration_ms, slow_level
from ..sources.logs import scratch


def durations(logs: DataFrame) -> DataFrame:
    return logs.select("seq", duration_ms(F.col("message")).alias("duration_ms")).where("duration_ms is not null")


def percentiles(values: DataFrame, column: str, at: tuple[float, ...]) -> DataFrame:
    """(p, value): exact percentiles by linear interpolation between ranks; no rows without values.

    Equal values are counted before they are shuffled. The distinct ones are dealt in ranges and written; the sums of the ranges tell
    which ones hold the ranks that are asked for, and only those are sorted and summed up, each in a task of its own.
    """
    spark = values.sparkSession
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part"))
    path = scratch(spark, "ranges")
    ranged.write.parquet(path)
    counts = spark.read.schema(ranged.schema).parquet(path)
    sizes = counts.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each range
    ends = sizes.select("part", "n", F.sum("n").over(Window.orderBy("part")).alias("end"))
    total = sizes.agg(F.sum("n").alias("total"))
    asked = total.select("total", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("p")).select("p", (F.col("p") * (F.col("total") - 1)).alias("place"))
    asked = asked.select("p", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    where = asked.join(F.broadcast(ends), (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n"))).select("p", "place", "rank", "part", (F.col("end") - F.col("n")).alias("start"))
    inside = counts.join(where.select("part").distinct(), "part", "left_semi").withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    found = inside.join(where, "part").where((F.col("rank") < F.col("start") + F.col("upto")) & (F.col("rank") >= F.col("start") + F.col("upto") - F.col("n")))
    low, high, share = F.min_by("v", "rank"), F.max_by("v", "rank"), F.first("place") - F.floor(F.first("place"))
    return found.groupBy("p").agg((low * (1 - share) + high * share).alias("value"))


def statistics(durations: DataFrame) -> DataFrame:
    """count, average, least, largest and the exact percentiles by linear interpolation; zeros without samples."""
    d = F.col("duration_ms")
    stats = durations.agg(F.count(d).alias("cnt"), F.avg(d).alias("average"), F.min(d).alias("least"), F.max(d).alias("largest"))
    asked = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranks = percentiles(durations, "duration_ms", tuple(asked.values())).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in asked.items()])
    both = stats.crossJoin(ranks)  # of one row each
    return both.select("cnt", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("average", "least", "largest", *asked)])


def slow_queries(logs: DataFrame, warning: float = 100, slow: float = 500, critical: float = 1000) -> DataFrame:
    """Rows above a threshold with their level."""
    found = logs.withColumn("duration_ms", duration_ms(F.col("message")))
    return found.withColumn("slow_level", slow_level(F.col("duration_ms"), warning, slow, critical)).where("slow_level is not null")
