"""Parameter suggestion: intrinsic dimension, counts and radii from nearest-neighbour distances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import pairs
from lattica.sources.stored import written

FLOOR = 1e-6
QUANTILES = (0.5, 0.7, 0.85)
_TINY = 1e-12


def sample(points: DataFrame, size: int, n: int, seed: int = 0) -> DataFrame:
    """size rows by the order of a seeded hash of the id, so the same rows at any partitioning; all if there are fewer."""
    return points if size >= n else points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)


def intrinsic_dimension(points: DataFrame, k: int = 20) -> DataFrame:
    """One row: the Levina-Bickel estimate, median over points of 1 / mean(ln(r_k / r_j)), j < k, cut to [1, 2 d]."""
    from lattica.functions import vectors

    n, d = vectors.check(points)
    k = min(max(4, k), n - 1)
    if k < 3:
        return points.sparkSession.createDataFrame([(float(d),)], "dim double")
    near = written(pairs.knn(points, k + 1, (n, d)).where("rank > 0"), "neighbours")  # read twice, searched once
    last = near.groupBy("id").agg(F.max("dist").alias("rk"))
    logs = near.where(F.col("rank") < k).join(last, "id").groupBy("id").agg(F.avg(F.ln((F.col("rk") + _TINY) / (F.col("dist") + _TINY))).alias("m"))
    dim = F.percentile(1 / F.greatest("m", F.lit(_TINY)), F.lit(0.5))
    return logs.agg(F.least(F.greatest(dim, F.lit(1.0)), F.lit(max(1.0, 2.0 * d))).alias("dim"))


def min_pts(n: int, dim: float) -> list[int]:
    """Half, once, twice and four times the base, max(4, ceil(2 dim), ceil(log2 n)), cut to [4, 256]."""
    base = max(4, math.ceil(2 * dim), math.ceil(math.log2(max(n, 2))))
    return sorted({min(256, max(4, b)) for b in (base // 2, base, 2 * base, 4 * base)})


def sampled_rank(population: int, size: int, count: int) -> int:
    """The rank in a sample, self included, that stands for a rank in the population."""
    if population <= 1 or size <= 1:
        return 1
    return min(size, max(2, 1 + round(max(0, count - 1) * (size - 1) / (population - 1))))


def eps(points: DataFrame, count: int, quantiles: tuple[float, ...] = QUANTILES, sample_size: int | None = None, truth: DataFrame | None = None) -> DataFrame:
    """One row, `eps`: ascending distinct float32 quantiles of the distance to the count-th neighbour, FLOOR at least.

    With a sample the rank shrinks with it. Rows that truth (id, truth) calls noise are left out where 50 rows and a
    tenth at least remain.
    """
    from lattica.functions import vectors

    n, d = vectors.check(points)
    size = min(n, sample_size or n)
    used = sample(points, size, n)
    rank = sampled_rank(n, size, count)
    dist = pairs.knn(used, rank, (size, d)).where(F.col("rank") == rank - 1)
    if truth is not None:
        dist = written(dist, "neighbours")
        clean = dist.join(truth.where("truth >= 0"), "id", "left_semi")
        if clean.count() >= max(50, 0.1 * size):
            dist = clean
    q = F.percentile("dist", F.array(*map(F.lit, quantiles)))
    cut = F.transform(q, lambda x: F.greatest(x, F.lit(FLOOR)).cast("float").cast("double"))
    return dist.agg(F.array_sort(F.array_distinct(cut)).alias("eps"))


def grid(points: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> dict:
    """Radii and counts for points; radii come from the middle count."""
    n = points.count()
    dim = intrinsic_dimension(points).first().dim
    counts = min_pts(n, dim)
    return {"dim": dim, "min_pts": counts, "eps": eps(points, counts[len(counts) // 2], quantiles).first().eps}
