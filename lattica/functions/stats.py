"""Statistics of repeated measurements: medians, spreads, paired ratios, bootstrap intervals, cost fits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 5
RESAMPLES = 10_000


def median(x: str | Column) -> Column:
    """Exact; the mean of the middle two of an even number."""
    return F.percentile(x, F.lit(0.5))


def descriptive(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """n, median, mean, stddev (sample; 0.0 of one), min, max, p25, p75, iqr for each key."""
    q = lambda p: F.percentile(x, F.lit(p))
    aggs = [F.count(x).alias("n"), median(x).alias("median"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"), q(0.25).alias("p25"), q(0.75).alias("p75"), (q(0.75) - q(0.25)).alias("iqr")]
    return rows.groupBy(*keys).agg(*aggs)


def bootstrap(rows: DataFrame, keys: list[str], x: str, order: str, resamples: int = RESAMPLES, seed: str | None = None) -> DataFrame:
    """(keys, n, low, high, conclusive): the 95 % interval of the median by resampling the values as ordered.

    Draws are seeded by the key alone, or by a column's text that is one in each group. A group holds the blocks of one
    case, some tens of values; it is all that a task gathers.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = str(pdf[seed].iloc[0]) if seed else "|".join(str(pdf[k].iloc[0]) for k in keys)
        values = pdf.sort_values(order)[x].tolist()
        rng = random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
        medians = np.median(np.array([[values[rng.randrange(len(values))] for _ in values] for _ in range(resamples)]), axis=1)
        low, high = np.percentile(medians, [2.5, 97.5])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(values), "low": low, "high": high, "conclusive": len(values) >= LEAST}])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, low double, high double, conclusive boolean"
    return rows.select(*keys, order, *([seed] if seed else []), F.col(x).cast("double").alias(x)).groupBy(*keys).applyInPandas(one, schema)


def paired_ratios(rows: DataFrame, keys: list[str], ratio: str = "ratio") -> DataFrame:
    """(keys, ratio): the geometric mean of two positive finite ratios; any other group is an error where the result is read."""
    ok = (F.count("*") == 2) & (F.count(ratio) == 2) & (F.min(ratio) > 0) & F.every(F.col(ratio) < float("inf"))
    got = rows.groupBy(*keys).agg(F.exp(F.avg(F.ln(ratio))).alias("mean"), F.coalesce(ok, F.lit(False)).alias("ok"))
    fault = F.concat(F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.lit(": needs two positive finite ratios"))
    return got.select(*keys, F.when(F.col("ok"), F.col("mean")).otherwise(F.raise_error(fault).cast("double")).alias(ratio))


def block_ratios(records: DataFrame, value: str = "fit_ms") -> DataFrame:
    """(case_id, block, multi, sequential, baseline, gain, speedup) of (case_id, block, method, value)."""
    wide = records.groupBy("case_id", "block").pivot("method", ["multi", "sequential", "baseline"]).agg(F.first(value))
    return wide.withColumns({"gain": F.col("sequential") / F.col("multi"), "speedup": F.col("baseline") / F.col("multi")})


def complete(records: DataFrame, expected: DataFrame, axes: list[str], case: str = "case_id") -> DataFrame:
    """Records of cases without missing, extra or failed axes; one such drops the whole case."""
    missing = expected.join(records, axes, "left_anti").select(case)
    extra = records.join(expected, axes, "left_anti").select(case)
    failed = records.where("not ok").select(case)
    return records.join(missing.union(extra).union(failed).distinct(), case, "left_anti")


def duplicates(records: DataFrame, axes: list[str]) -> DataFrame:
    """Axes that occur more than once, and how often; none, if all is well."""
    return records.groupBy(*axes).agg(F.count("*").alias("n")).where("n > 1")


def cost_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, marginal, fixed, ceiling): y = fixed + marginal * x by least squares, and the most that sharing can gain."""
    got = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("marginal"), F.regr_intercept(y, x).alias("fixed"))
    return got.withColumn("ceiling", (F.col("fixed") + F.col("marginal")) / F.col("marginal"))


def degradation(rows: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """(keys, degradation): the mean of all but the first value over the first, in order."""
    first = F.min_by(x, order)
    return rows.groupBy(*keys).agg(((F.sum(x) - first) / (F.count(x) - 1) / first).alias("degradation"))


def marginal_cost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, marginal): (grid - least solo) / (configurations - 1), of (grid_ms, solo_ms) by configuration."""
    return rows.groupBy(*keys).agg(((F.max("grid_ms") - F.min("solo_ms")) / (F.count("*") - 1)).alias("marginal"))


def phases(rows: DataFrame, edges: Column | int) -> DataFrame:
    """(phase, ms, per_config, share, ms_per_1e9_edges) of (phase, ms, per_config): each phase's part of the whole."""
    whole = rows.agg(F.sum("ms").alias("whole"))
    got = rows.groupBy("phase", "per_config").agg(F.sum("ms").alias("ms")).crossJoin(F.broadcast(whole))  # a single row
    per = F.col("ms") * 1e9 / (F.lit(edges) if isinstance(edges, int) else edges)
    return got.select("phase", "per_config", "ms", (F.col("ms") / F.col("whole")).alias("share"), per.alias("ms_per_1e9_edges"))


def profile(phases: DataFrame) -> DataFrame:
    """(shared, per_config, total, share_shared, ceiling) of (phase, ms, per_config)."""
    own = F.sum(F.when(F.col("per_config"), F.col("ms")).otherwise(0.0))
    total = F.sum("ms")
    return phases.agg((total - own).alias("shared"), own.alias("per_config"), total.alias("total"), ((total - own) / total).alias("share_shared"), (total / own).alias("ceiling"))


def overhead(solo: DataFrame, baseline: DataFrame) -> DataFrame:
    """(median, max) of own solo time over the baseline's, by configuration."""
    both = solo.select("config", F.col("ms").alias("own")).join(baseline.select("config", F.col("ms").alias("base")), "config")
    return both.select((F.col("own") / F.col("base")).alias("t")).agg(median("t").alias("median"), F.max("t").alias("max"))


def method_order(methods: list[str], case: int, block: int) -> list[str]:
    """Rotated by case and pair; odd blocks reversed."""
    k = (case + block // 2) % len(methods)
    turned = methods[k:] + methods[:k]
    return turned[::-1] if block % 2 else turned
