"""Degrees, core flags and totals of a pair table. Every point counts itself, so degrees start at 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import vectors


def ends(table: DataFrame) -> DataFrame:
    """Both ends of every pair."""
    return table.select("code", F.explode(F.array("i", "j")).alias("id"))


def degrees(points: DataFrame, table: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    """(id, deg ARRAY<BIGINT>): the degree at each of k radii, for every point; with weights (id, weight), points count so often."""
    if weights is not None:
        both = table.select("code", F.col("i").alias("at"), F.col("j").alias("id")).union(table.select("code", "j", "i"))
        both = both.join(weights, "id").groupBy("at").agg(*(F.sum(F.when(F.col("code") <= e, F.col("weight"))).alias(f"e{e}") for e in range(k)))
        deg = F.array(*(F.col("weight") + F.coalesce(F.col(f"e{e}"), F.lit(0)) for e in range(k)))
        return weights.join(both.withColumnRenamed("at", "id"), "id", "left").select("id", deg.alias("deg"))
    found = ends(table).groupBy("id").agg(*(F.count_if(F.col("code") <= e).alias(f"e{e}") for e in range(k)))
    deg = F.array(*(F.lit(1).cast("bigint") + F.coalesce(F.col(f"e{e}"), F.lit(0)) for e in range(k)))
    return points.select("id").join(found, "id", "left").select("id", deg.alias("deg"))


def long_degrees(deg: DataFrame) -> DataFrame:
    return deg.select("id", F.posexplode("deg").alias("eps_idx", "degree"))


def totals(deg: DataFrame) -> DataFrame:
    """(eps_idx, n, nnz, max_degree, density, mean_degree): ordered pairs with self at each radius."""
    got = long_degrees(deg).groupBy("eps_idx").agg(F.count("*").alias("n"), F.sum("degree").alias("nnz"), F.max("degree").alias("max_degree"))
    share, mean = vectors.density(F.col("nnz"), F.col("n"))
    return got.withColumns({"density": share, "mean_degree": mean})


def offsets(deg: DataFrame, radius: int) -> DataFrame:
    """(id, degree, row_offset): the row starts of a compressed adjacency, rows by id.

    The running sum goes by id buckets first, so that it needs no task with all rows.
    """
    rows = deg.select("id", F.col("deg")[radius].alias("degree"), F.floor(F.col("id") / F.lit(1 << 16)).alias("bucket"))
    sums = rows.groupBy("bucket").agg(F.sum("degree").alias("s"))
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("before"))
    inner = Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "bucket").select("id", "degree", (F.col("before") + F.coalesce(F.sum("degree").over(inner), F.lit(0))).alias("row_offset"))


def columns(table: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """(id, place, neighbour): the column indices of the compressed adjacency, ascending in each row, self included.

    An entry stands at row_offset + place, with the row_offset of `offsets`. A row is one point's neighbours.
    """
    near = table.where(F.col("code") <= radius)
    entries = near.select(F.col("i").alias("id"), F.col("j").alias("neighbour")).union(near.select("j", "i")).union(points.select("id", "id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("neighbour")) - 1
    return entries.select("id", place.cast("bigint").alias("place"), "neighbour")


def core_radius(deg: DataFrame, min_pts: list[int]) -> DataFrame:
    """(mp_idx, id, c): the smallest radius index at which a point is core for a count; points that never are have no row.

    Degrees grow with the radius, so one number tells the flags of all radii.
    """
    each = F.array(*(F.struct(F.lit(m).alias("mp_idx"), F.expr(f"size(filter(deg, x -> x < {p}))").alias("c")) for m, p in enumerate(min_pts)))
    return deg.select("id", F.size("deg").alias("k"), F.explode(each).alias("x")).select("x.mp_idx", "id", "x.c", "k").where("c < k").drop("k")


def core_masks(deg: DataFrame, min_pts: list[int]) -> DataFrame:
    """(config, id, is_core) of the whole grid."""
    long = long_degrees(deg)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mp_idx"), F.lit(p).alias("min_pts")) for m, p in enumerate(min_pts))))
    return long.select("id", "eps_idx", "degree", each.alias("x")).select((F.col("eps_idx") * len(min_pts) + F.col("x.mp_idx")).alias("config"), "id", (F.col("degree") >= F.col("x.min_pts")).alias("is_core"))
