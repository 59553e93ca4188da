"""Column expressions over points (id BIGINT, v ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def unrolled_distance(a: str, b: str, d: int) -> Column:
    """The same for a known width, without lambdas, so that it stays inside generated code."""
    out = F.lit(0.0)
    for k in range(d):
        x = F.col(f"{a}.v")[k] - F.col(f"{b}.v")[k]
        out = out + x * x
    return out


def code(d2: Column, eps: list[float]) -> Column:
    """Index of the smallest radius that holds a squared distance; null beyond the largest. Balls are closed."""
    out = F.when(d2 <= eps[0] * eps[0], 0)
    for k, e in enumerate(eps[1:], 1):
        out = out.when(d2 <= e * e, k)
    return out


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def checks(points: DataFrame) -> DataFrame:
    """One row: n, d, whether all widths agree and all values are finite, and whether ids are distinct."""
    return points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"), (F.coalesce(F.min(F.size("v")), F.lit(0)) == F.coalesce(F.max(F.size("v")), F.lit(0))).alias("even"), F.coalesce(F.every(is_finite(F.col("v"))), F.lit(True)).alias("finite"), (F.count_distinct("id") == F.count("*")).alias("distinct_ids"))


def check(points: DataFrame) -> tuple[int, int]:
    """n and d of points that can be clustered; raises else."""
    row = checks(points).first()
    if not row.even or not row.finite or not row.distinct_ids:
        raise ValueError(f"points need one width, finite values and distinct ids: {row.asDict()}")
    return row.n, row.d


def min_max(points: DataFrame, d: int) -> DataFrame:
    """Scales every coordinate to [0, 1]; a constant one becomes 0."""
    ends = points.agg(*(f(F.col("v")[k]).alias(f"{n}{k}") for k in range(d) for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = [(F.col("v")[k] - F.col(f"lo{k}")) / F.coalesce(F.nullif(F.col(f"hi{k}") - F.col(f"lo{k}"), F.lit(0.0)), F.lit(1.0)) for k in range(d)]
    return points.crossJoin(F.broadcast(ends)).select("id", F.array(*scaled).alias("v"))


def widen(points: DataFrame, dim: int, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """Two coordinates to dim ones: linear, periodic and product features of them in turn, with a little noise."""
    x, y = F.col("v")[0], F.col("v")[1]
    made = [x, y, x + y, x - y, F.sin(x), F.cos(y), x * y, x * x - y * y]
    return points.select("id", F.array(*(made[k % len(made)] * (1.0 + 0.1 * (k // len(made))) + (F.randn(seed + k) * noise if k > 1 else 0.0) for k in range(dim))).alias("v"))


def density(nnz: Column, n: Column) -> tuple[Column, Column]:
    """Share of ordered pairs, self included, and mean degree."""
    return nnz / (n.cast("double") * n), nnz / n
