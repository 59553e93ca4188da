"""Data sets: points, true labels and metadata below one path, written with their hashes and validated as a whole."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import grid, vectors
from lattica.sources.points import fingerprint, label_fingerprint

#: What metadata must tell (fixed values).
FIELDS = ("protocol", "dataset", "n", "d", "seed", "config_order", "dtype", "layout", "eps_quantiles", "eps", "min_samples", "generator", "sha256")
LAYOUT = {"config_order": "eps_major", "dtype": "float32", "layout": "row-major"}


def write_dataset(points: DataFrame, truth: DataFrame, meta: dict, path: str) -> dict:
    """Writes points (id, v), truth (id, truth) and the metadata, with hashes, sizes and layout added; returns it."""
    n, d = vectors.check(points)
    points.select("id", "v").write.parquet(f"{path}/points")
    truth.select("id", "truth").write.parquet(f"{path}/truth")
    full = meta | LAYOUT | {"n": n, "d": d, "sha256": {"points": fingerprint(points).first().sha256, "truth": label_fingerprint(truth).first().sha256}}
    points.sparkSession.createDataFrame([(json.dumps(full, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return full


def metadata(spark: SparkSession, path: str) -> dict:
    """A data set's metadata; every field must be there."""
    meta = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/metadata").collect()))
    if missing := [f for f in FIELDS if f not in meta]:
        raise ValueError(f"{path}: metadata lacks {missing}")
    return meta


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x > 0


def faults(meta: dict, protocol: dict, dataset: str, n: int) -> list[str]:
    """What of the metadata contradicts the protocol (its name, seed, generator, eps_quantiles and pool_size), in order."""
    wanted = {"protocol": protocol["name"], "dataset": dataset, "n": n, "seed": protocol["seed"], "generator": protocol["generator"], **LAYOUT}
    found = [f"{k} is {meta[k]!r}, not {v!r}" for k, v in wanted.items() if meta[k] != v]
    if not _whole(meta["d"]):
        found.append("d is no positive integer")
    elif not (m := re.search(r"_([1-9][0-9]*)d$", dataset)) or int(m[1]) != meta["d"]:
        found.append("d is not the name's")
    if [float(q) for q in meta["eps_quantiles"]] != [float(q) for q in protocol["eps_quantiles"]]:
        found.append("eps_quantiles are not the protocol's")
    eps = [float(e) for e in meta["eps"]]
    if len(eps) != len(protocol["eps_quantiles"]) or not all(math.isfinite(e) and e > 0 for e in eps) or eps != sorted(set(eps)):
        found.append("eps are not positive, distinct and ascending, one for each quantile")
    if not meta["min_samples"] or not all(map(_whole, meta["min_samples"])):
        found.append("min_samples are no positive integers")
    return found


def validate_dataset(spark: SparkSession, path: str, dataset: str, n: int, protocol: dict) -> dict:
    """A data set's grid and pools, if its metadata, sizes, hashes and values are as the protocol says; raises else."""
    meta = metadata(spark, path)
    points, truth = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/truth")
    found = faults(meta, protocol, dataset, n)
    own = vectors.checks(points).first()
    if (own.n, own.d, own.even, own.distinct_ids) != (meta["n"], meta["d"], True, True):
        found.append(f"points are {own.n} x {own.d}, not {meta['n']} x {meta['d']}")
    if not own.finite:
        found.append("points are not finite")
    if truth.join(points.select("id"), "id").count() != meta["n"] or truth.count() != meta["n"]:
        found.append("truth has other rows than points")
    for name, got in (("points", fingerprint(points)), ("truth", label_fingerprint(truth))):
        if got.first().sha256 != meta["sha256"].get(name):
            found.append(f"{name} have another hash")
    if found:
        raise ValueError(f"{path}: " + "; ".join(found))
    return {"dataset": dataset, "n": n, "d": meta["d"], "seed": meta["seed"], "eps_pool": [float(e) for e in meta["eps"]], "minpts_pool": grid.min_pts_pool(meta["min_samples"], protocol["pool_size"]), "sha256": meta["sha256"], "path": path}


def lookup(cases: DataFrame, datasets: DataFrame) -> DataFrame:
    """Cases (dataset, n, eps_indices, minpts_indices, ...) with their data set's pools resolved to `eps` and `min_samples`.

    datasets: dataset, n, eps_pool, minpts_pool. A case without its data set, or with an index beyond a pool, is an error
    where the result is read.
    """
    got = cases.join(datasets.select("dataset", "n", "eps_pool", "minpts_pool"), ["dataset", "n"], "left")
    picked = {"eps": ("eps_indices", "eps_pool"), "min_samples": ("minpts_indices", "minpts_pool")}
    got = got.withColumns({out: _picked(index, pool, datasets.schema[pool].dataType) for out, (index, pool) in picked.items()})
    return got.drop("eps_pool", "minpts_pool")


def _picked(index: str, pool: str, kind) -> Column:
    inside = F.col(pool).isNotNull() & F.forall(index, lambda k: k.between(0, F.size(pool) - 1))
    fault = F.concat(F.col("dataset"), F.lit(f": no data set, or {index} beyond its pool"))
    return F.when(inside, F.transform(index, lambda k: F.get(pool, k))).otherwise(F.raise_error(fault).cast(kind))
