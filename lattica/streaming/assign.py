"""Streams of new points: each joins the cluster of its nearest core point within the radius, else it is noise.

A fitted model's core points are the static side; the stream side is stateless, so nothing grows with the stream and
no watermark is needed. Fitting again is a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import vectors


def assign(stream: DataFrame, core: DataFrame, eps: float, d: int, axes: int = 3) -> DataFrame:
    """stream: (id, v); core: (id, v, label). One row (id, label, dist) for each point beside a core point and core point
    within eps, of which the sink keeps the nearest by `nearest`; cells of the radius keep the join an equi-join."""
    axes = min(axes, d)
    cell = lambda k: F.floor(F.col("v")[k] / eps).cast("bigint")
    new = stream.select("id", "v", *(cell(k).alias(f"c{k}") for k in range(axes)))
    held = core.select(F.col("v").alias("w"), "label", *(cell(k).alias(f"h{k}") for k in range(axes)))
    for k in range(axes):
        held = held.withColumn(f"c{k}", F.explode(F.array(F.col(f"h{k}") - 1, F.col(f"h{k}"), F.col(f"h{k}") + 1)))
    near = new.join(held, [f"c{k}" for k in range(axes)])
    return near.select("id", "label", vectors.squared_distance(F.col("v"), F.col("w")).alias("d2")).where(F.col("d2") <= eps * eps).select("id", "label", F.sqrt("d2").alias("dist"))


def nearest(batch: DataFrame, points: DataFrame) -> DataFrame:
    """(id, label, dist) of a micro-batch: the nearest core point's label, the smaller of equals; -1 for others."""
    best = batch.groupBy("id").agg(F.min(F.struct("dist", "label")).alias("m"))
    return points.select("id").join(best, "id", "left").select("id", F.coalesce("m.label", F.lit(-1)).alias("label"), F.col("m.dist").alias("dist"))
