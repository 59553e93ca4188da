"""Synthetic point families as column expressions over a range of ids.

Every random number is a hash of (id, seed, use), so a family is the same at any number of partitions and any size
can be generated where it is used. A family is a list of parts; a part is a share of the ids with one true label and
coordinate expressions. Families of two true dimensions are widened to the asked dimension.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import vectors

ARTICLE = ("dense_blobs", "heterogeneous_blobs", "moons", "rings", "spiral")
STRESS = ("nested_blobs", "power_law_blobs", "many_blobs", "uniform", "filaments", "core_halo")
FAMILIES = (*ARTICLE, "dense_blobs_noise", "blobs", "anisotropic_blobs", "varied_blobs", "chain_bridge", "grid_blobs", *STRESS)
SIZES = (4_000, 16_000, 32_000, 64_000, 128_000, 256_000, 512_000, 1_000_000)
DIMS = (2, 4, 10, 12, 14, 16, 20, 32)
PRESETS = {"artigo": (ARTICLE, DIMS, SIZES), "escala": ((*STRESS, *ARTICLE), (2, 16), SIZES), "estresse": (STRESS, (2, 16, 32), SIZES)}


def uniform(seed: int, use: int) -> Column:
    """In (0, 1), by id."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(use)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, use: int, sd: float = 1.0) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, 2 * use))) * F.cos(2 * math.pi * uniform(seed, 2 * use + 1)) * sd


def centers(dim: int, count: int, scale: float) -> np.ndarray:
    """Normal draws that depend on dim and count alone, each pushed out along an axis of its own."""
    found = np.random.default_rng(1000 + dim + count).normal(0.0, scale, (count, dim))
    turn = np.arange(count)
    found[turn, turn % dim] += np.where(turn % 2 == 0, scale, -scale)
    return found


@dataclass
class Part:
    size: int
    label: int
    at: list[Column]


def _around(center, sd: float, seed: int) -> list[Column]:
    return [F.lit(float(c)) + normal(seed, k, sd) for k, c in enumerate(center)]


def _even(n: int, k: int) -> list[int]:
    return [n // k + (n % k if i == k - 1 else 0) for i in range(k)]


def _blobs(n: int, at, sd, seed: int, sizes: list[int] | None = None) -> list[Part]:
    sds = sd if isinstance(sd, (list, tuple)) else [sd] * len(at)
    return [Part(s, k, _around(c, sds[k], seed + k)) for k, (c, s) in enumerate(zip(at, sizes or _even(n, len(at)), strict=True))]


def _turn() -> Column:
    """The place of a row in its part, from 0 to 1."""
    return F.col("place") / F.greatest(F.col("size") - 1, F.lit(1))


def parts(family: str, n: int, dim: int, seed: int) -> tuple[list[Part], bool]:
    """The parts of a family, and whether they are two-dimensional."""
    flat = lambda c, s: [F.lit(float(c[0])) + s[0], F.lit(float(c[1])) + s[1]]
    if family == "dense_blobs":
        return _blobs(n, centers(dim, 4, 4.5), 0.16, seed), False
    if family == "heterogeneous_blobs":
        sizes = [int(0.42 * n), int(0.33 * n)]
        return _blobs(n, centers(dim, 3, 4.5), [0.08, 0.28, 0.72], seed, [*sizes, n - sum(sizes)]), False
    if family == "dense_blobs_noise":
        noise, at = max(1, n // 5), centers(dim, 4, 4.2)
        low, wide = float(at.min()) - 3, float(np.ptp(at)) + 6
        return [*_blobs(n - noise, at, 0.18, seed), Part(noise, -1, [low + wide * uniform(seed + 9, k) for k in range(dim)])], False
    if family == "blobs":
        return _blobs(n, np.random.default_rng(seed).uniform(-10, 10, (6, dim)), 0.45, seed), False
    if family == "moons":
        angle = _turn() * math.pi
        jitter = [normal(seed, 1, 0.045), normal(seed, 2, 0.045)]
        a, b = _even(n, 2)
        return [Part(a, 0, flat((0, 0), [F.cos(angle) + jitter[0], F.sin(angle) + jitter[1]])), Part(b, 1, flat((1, 0.5), [jitter[0] - F.cos(angle), jitter[1] - F.sin(angle)]))], True
    if family == "rings":
        angle, sizes = _turn() * 2 * math.pi, _even(n, 2)
        return [Part(s, k, [F.cos(angle) * r + normal(seed, 1, 0.025), F.sin(angle) * r + normal(seed, 2, 0.025)]) for k, (s, r) in enumerate(zip(sizes, (1.0, 0.38), strict=True))], True
    if family == "spiral":
        arms, radius = 3, 0.08 + 0.92 * _turn()
        angle = 0.35 + (4.2 * math.pi - 0.35) * _turn()
        return [Part(s, k, [radius * F.cos(angle + 2 * math.pi * k / arms) + normal(seed, 1, 0.025), radius * F.sin(angle + 2 * math.pi * k / arms) + normal(seed, 2, 0.025)]) for k, s in enumerate(_even(n, arms))], True
    if family == "anisotropic_blobs":
        made = _blobs(n, [(-3, -1.5), (0, 2.2), (3, -1.0), (4.5, 2.5)], 0.35, seed)
        return [Part(p.size, p.label, [p.at[0] * 0.85 + p.at[1] * 0.35, p.at[0] * -0.55 + p.at[1] * 1.35]) for p in made], True
    if family == "varied_blobs":
        return _blobs(n, [(-4, -2), (0, 2), (3.5, -1.5), (4, 3.2)], [0.08, 0.18, 0.42, 0.75], seed), True
    if family == "chain_bridge":
        bridge = max(8, int(0.16 * n))
        left, right = (n - bridge) // 2, n - bridge - (n - bridge) // 2
        return [Part(left, 0, _around((-3, 0), 0.22, seed + 1)), Part(bridge, 2, [-2.35 + 4.7 * _turn(), normal(seed, 3, 0.055)]), Part(right, 1, _around((3, 0), 0.22, seed + 2))], True
    if family == "grid_blobs":
        return _blobs(n, [(x, y) for x in (-3, 0, 3) for y in (-3, 0, 3)], 0.10, seed), True
    if family == "nested_blobs":
        rng, at = np.random.default_rng(2000 + dim), []
        for c in centers(dim, 3, 7.0):
            off = rng.normal(0, 1, (4, dim))
            at += list(c + 1.3 * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-6))
        return _blobs(n, at, 0.13, seed), False
    if family == "power_law_blobs":
        share = np.arange(1, 9.0) ** -1.2
        sizes = 1 + np.floor(share / share.sum() * (n - 8)).astype(int)
        sizes[0] += n - sizes.sum()
        return _blobs(n, centers(dim, 8, 5.0), 0.20, seed, sizes.tolist()), False
    if family == "many_blobs":
        count = min(512, max(16, int(math.sqrt(n) / 2)))
        side = math.ceil(math.sqrt(count))
        cell = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(77)), F.lit(count))
        return [Part(n, -2, [F.floor(cell / side) + normal(seed, 1, 0.11), cell % side + normal(seed, 2, 0.11)])], True
    if family == "uniform":
        return [Part(n, -1, [uniform(seed, k) for k in range(dim)])], False
    if family == "filaments":
        rng, out = np.random.default_rng(3000 + dim), []
        for k, s in enumerate(_even(n, 6)):
            start, way = rng.normal(0, 3, dim), rng.normal(0, 1, dim)
            way /= max(1e-6, np.linalg.norm(way))
            out.append(Part(s, k, [float(a) + 6 * _turn() * float(w) + normal(seed + k, c, 0.06) for c, (a, w) in enumerate(zip(start, way, strict=True))]))
        return out, False
    if family == "core_halo":
        out = []
        for k, (c, s) in enumerate(zip(centers(dim, 4, 5.0), _even(n, 4), strict=True)):
            core = int(0.6 * (n // 4))
            out += [Part(core, k, _around(c, 0.10, seed + k)), Part(s - core, k, _around(c, 0.50, seed + 10 + k))]
        return out, False
    raise ValueError(f"unknown family {family}")


def generate(spark: SparkSession, family: str, n: int, dim: int = 2, seed: int = 42) -> DataFrame:
    """(id, v, truth): n points of a family; truth -1 is noise. Coordinates are rounded to float32."""
    if n < 8:
        raise ValueError("n must be 8 at least")
    made, flat = parts(family, n, dim, seed)
    rows, lo, out = spark.range(n), 0, None
    for p in made:
        own = rows.where((F.col("id") >= lo) & (F.col("id") < lo + p.size)).withColumns({"place": F.col("id") - lo, "size": F.lit(p.size)})
        label = F.lit(p.label) if p.label != -2 else F.pmod(F.xxhash64("id", F.lit(seed), F.lit(77)), F.lit(min(512, max(16, int(math.sqrt(n) / 2)))))
        own = own.select("id", F.array(*(c.cast("float").cast("double") for c in p.at)).alias("v"), label.cast("int").alias("truth"))
        out = own if out is None else out.unionByName(own)
        lo += p.size
    return vectors.widen(out, dim, seed=seed).join(out.select("id", "truth"), "id") if flat and dim > 2 else (out.select("id", F.slice("v", 1, dim).alias("v"), "truth") if flat else out)


def planned(preset: str) -> list[dict]:
    """What a preset would generate, with bytes of float32 points and int32 labels."""
    names, dims, sizes = PRESETS[preset]
    return [{"family": f, "d": d, "n": n, "bytes": n * d * 4 + n * 4} for f in names for d in dims for n in sizes]


def three_blobs(spark: SparkSession, n: int, d: int, seed: int = 1) -> DataFrame:
    """Three Gaussian centres in a plane, other coordinates zero: the self-test's points."""
    turn = F.pmod("id", F.lit(3))
    x = [F.element_at(F.array(F.lit(0.0), F.lit(4.0), F.lit(-4.0)), (turn + 1).cast("int")), F.element_at(F.array(F.lit(0.0), F.lit(4.0), F.lit(4.0)), (turn + 1).cast("int"))]
    return spark.range(n).select("id", F.array(*([x[k] + normal(seed, k, 0.2) if k < 2 else F.lit(0.0) for k in range(d)])).alias("v"))
