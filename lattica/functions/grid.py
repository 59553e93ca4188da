"""Parameter grids: parsing, ranges, pools, products. Driver-side; a grid has tens of values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MAX_RADII = 16


def parse_list(text: str, kind: type = float) -> list:
    """Comma-separated numbers; empty items, trailing text and values that are not finite and positive are errors."""
    out = []
    for item in text.split(","):
        try:
            value = kind(item.strip())
        except ValueError:
            raise ValueError(f"not a number: {item!r}") from None
        if not math.isfinite(value) or value <= 0:
            raise ValueError(f"must be finite and positive: {item!r}")
        out.append(value)
    return out


def expand_range(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high, which a hair of rounding doesn't exclude; a step that misses high omits it."""
    if not (all(map(math.isfinite, (low, high, step))) and step > 0 and 0 < low <= high):
        raise ValueError("need 0 < low <= high and step > 0, all finite")
    slack = 1e-9 * max(1.0, abs(high))
    count = int(math.floor((high + slack - low) / step)) + 1
    return [v for v in (low + k * step for k in range(count + 1)) if v <= high + slack]


def normalize(values: list) -> list:
    return sorted(set(values))


def radii(values: list[float]) -> list[float]:
    out = normalize([float(v) for v in values])
    if not 1 <= len(out) <= MAX_RADII or any(not math.isfinite(v) or v <= 0 for v in out):
        raise ValueError(f"need 1 to {MAX_RADII} finite positive radii")
    return out


def densities(values: list[int]) -> list[int]:
    out = normalize([int(v) for v in values])
    if not out or out[0] < 1:
        raise ValueError("need positive counts")
    return out


def configurations(spark: SparkSession, eps: list[float], min_pts: list[int]) -> DataFrame:
    """The product, radius-major: config = eps_idx * number of counts + mp_idx."""
    rows = [(e * len(min_pts) + m, e, float(x), m, int(y)) for e, x in enumerate(eps) for m, y in enumerate(min_pts)]
    return spark.createDataFrame(rows, "config int, eps_idx int, eps double, mp_idx int, min_pts int")


def _fill(taken: set[int], low: int, size: int) -> None:
    k = low
    while len(taken) < size:
        taken.add(k)
        k += 1


def min_pts_pool(values: list[int], size: int) -> list[int]:
    """size counts from the least to the largest value, spaced geometrically and rounded half to even.

    Where rounding has merged some, the smallest unused numbers take their place. Were there too many, the interior
    one nearest to a neighbour would go, the smaller of equals first.
    """
    own = densities(values)
    low, high = own[0], own[-1]
    if size > high - low + 1:
        raise ValueError(f"{low} to {high} holds fewer than {size} numbers")
    if size == 1:
        return [low]
    grid = np.round(np.geomspace(low, high, size)).astype(int)
    pool = set(grid.clip(low, high).tolist()) | {low, high}
    _fill(pool, low, size)
    line = sorted(pool)
    while len(line) > size:
        gaps = np.diff(line)
        nearest = np.minimum(gaps[:-1], gaps[1:])
        del line[1 + int(nearest.argmin())]
    return line


def min_pts_pool_beyond(values: list[int], size: int) -> list[int]:
    """As `min_pts_pool`, but gaps are filled above the largest value."""
    low, high = min(values), max(values)
    pool = {round(math.exp(math.log(low) + (math.log(high) - math.log(low)) * k / max(1, size - 1))) for k in range(size)}
    _fill(pool, high + 1, size)
    return sorted(pool)


def resolve(case: dict, eps_pool: list[float], min_pts_pool: list[int]) -> dict:
    """A case's grid values by index; they must be ascending and distinct."""
    out = case | {"eps": [eps_pool[k] for k in case["eps_indices"]], "min_pts": [min_pts_pool[k] for k in case["minpts_indices"]]}
    for name in ("eps", "min_pts"):
        if out[name] != normalize(out[name]):
            raise ValueError(f"{case.get('id')}: {name} is not ascending and distinct")
    return out


def plan_counts(cases: list[dict], samples: int, warmup: int) -> dict:
    """Records and fits that a plan of cases asks for.

    Each case is measured by every route of the grid method and by two sequential methods, which fit each
    configuration alone; every measured sample comes with so many warm-up runs.
    """
    routes = sum(len(c["routes"]) for c in cases)
    configs = sum(len(c["eps_indices"]) * len(c["minpts_indices"]) for c in cases)
    fits = samples * (routes + 2 * configs)
    return {"cases": len(cases), "variants": routes + 2 * len(cases), "records": samples * (routes + 2 * len(cases)), "measured_fits": fits, "warmup_fits": fits * warmup, "total_fits": fits * (warmup + 1)}
