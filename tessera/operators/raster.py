"""Rasters as (px, py, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixel(s: Column, size: int) -> Column:
    return F.greatest(F.least(F.floor(s * size).cast("int"), F.lit(size - 1)), F.lit(0))


def lookup(points: DataFrame, raster: DataFrame, width: int, height: int) -> DataFrame:
    """points (with u, v) and the value of their nearest pixel."""
    at = points.withColumn("px", pixel(F.col("u"), width)).withColumn("py", pixel(F.col("v"), height))
    return at.join(raster, ["px", "py"], "left")


def binary(raster: DataFrame, threshold: int, low: int, high: int) -> DataFrame:
    return raster.withColumn("value", F.when(F.col("value") <= threshold, low).otherwise(high))


def limited(raster: DataFrame, low: int, high: int) -> DataFrame:
    return raster.withColumn("value", F.greatest(F.least("value", F.lit(high)), F.lit(low)))


def periodic(raster: DataFrame) -> DataFrame:
    """The first column replaced by the last."""
    row = Window.partitionBy("py").orderBy("px").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return raster.withColumn("value", F.when(F.col("px") == 0, F.last("value").over(row)).otherwise(F.col("value")))


def smoothed(raster: DataFrame, width: int, height: int) -> DataFrame:
    """Each inner pixel the truncated mean of its eight neighbours, all from the old image; edges stay."""
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    each = raster.select("px", "py", "value", F.explode(around).alias("d"))
    sent = each.select((F.col("px") + F.col("d.dx")).alias("px"), (F.col("py") + F.col("d.dy")).alias("py"), "value")
    mean = sent.groupBy("px", "py").agg(F.floor(F.avg("value")).cast("int").alias("mean"))
    inner = (F.col("px") > 0) & (F.col("px") < width - 1) & (F.col("py") > 0) & (F.col("py") < height - 1)
    return raster.join(mean, ["px", "py"], "left").select("px", "py", F.when(inner, F.col("mean")).otherwise(F.col("value")).alias("value"))
