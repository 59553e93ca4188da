"""Campaign records: their axes against the plan, and the summary of their paired ratios.

A record is one measured sample of a case by a method: sample_id, case_id, block, order_index, method, route, sample_kind,
pair_index, direction, repetition, fit_ms, density, configuration_fit (config, eps, min_samples, fit_ms for each scalar
fit; empty for `multi`), clusters and noise (one for each configuration), identity (hashes by name), boundary,
budget_bytes, and the case's parameters. Cases: case_id, case_index, the parameters, routes and identity. Cases and
methods are tens; records are any number and are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import stats

MULTI, SEQUENTIAL, BASELINE = "multi", "sequential", "baseline"
#: The route of methods that have none, and the index of one that does not tell (fixed values).
NO_ROUTE, OWN_INDEX = "not-applicable", "implementation-default"
PARAMETERS = ("dataset", "n", "d", "seed", "k", "l", "eps", "min_samples", "tier", "index")
AXES = ["case_id", "block", "method", "route"]


def methods(routes: Column) -> Column:
    """(method, route) of a case in the order that blocks rotate."""
    own = F.transform(routes, lambda r: F.struct(F.lit(MULTI).alias("method"), r.alias("route")))
    return F.concat(own, F.array(*(F.struct(F.lit(m).alias("method"), F.lit(NO_ROUTE).alias("route")) for m in (SEQUENTIAL, BASELINE))))


def axis_faults(records: DataFrame, cases: DataFrame, protocol: dict) -> DataFrame:
    """(sample_id, fault): what of a record contradicts the plan; none, if all is well.

    protocol: samples (blocks of a case), boundary (where timing starts and ends), budget_mb.
    """
    own = cases.select("case_id", *(F.col(c).alias(f"case_{c}") for c in ("case_index", *PARAMETERS, "routes", "identity")))
    rows = records.join(F.broadcast(own), "case_id", "left")
    odd, pair = F.col("block") % 2 == 1, F.expr("cast(block div 2 as int)")
    rows = rows.withColumn("planned", methods(F.col("case_routes")))
    size = F.size("planned")
    place = F.when(odd, size - 1 - F.col("order_index")).otherwise(F.col("order_index"))
    expected = F.when(F.col("order_index").between(0, size - 1), F.get("planned", F.pmod(place + F.col("case_case_index") + pair, size)))
    rows = rows.withColumn("expected", expected)
    method, route = F.col("expected.method"), F.col("expected.route")
    name = F.concat(F.format_string("%s.b%02d.p%02d.", "case_id", "block", "order_index"), method, F.when(method == MULTI, F.concat(F.lit("."), route)).otherwise(""))
    grid = F.flatten(F.transform("case_eps", lambda e, i: F.transform("case_min_samples", lambda m, j: F.struct((i * F.size("case_min_samples") + j).alias("config"), e.alias("eps"), m.alias("min_samples")))))
    told = F.transform("configuration_fit", lambda c: F.struct(c["config"].alias("config"), c["eps"].alias("eps"), c["min_samples"].alias("min_samples")))
    total = F.aggregate("configuration_fit", F.lit(0.0), lambda s, c: s + c["fit_ms"])
    scalar, differs = F.col("method") != MULTI, lambda a, b: ~a.eqNullSafe(b)
    close = F.abs(total - F.col("fit_ms")) <= F.greatest(1e-12 * F.greatest(F.abs(total), F.abs(F.col("fit_ms"))), F.lit(1e-9))
    count = F.col("case_k") * F.col("case_l")
    wanted = {c: F.when(F.col("method") == BASELINE, OWN_INDEX).otherwise(F.col("case_index")) if c == "index" else F.col(f"case_{c}") for c in PARAMETERS}
    rules = {
        "block": ~F.col("block").between(0, protocol["samples"] - 1),
        "sample_kind": differs(F.col("sample_kind"), F.lit("measured")),
        "pair_index": differs(F.col("pair_index"), pair),
        "direction": differs(F.col("direction"), F.when(odd, "reverse").otherwise("forward")),
        "repetition": differs(F.col("repetition"), F.col("block")),
        "order_index": F.col("expected").isNull(),
        "order": F.col("expected").isNotNull() & (differs(F.col("method"), method) | differs(F.col("route"), route)),
        "sample_id": F.col("expected").isNotNull() & differs(F.col("sample_id"), name),
        "boundary": differs(F.col("boundary"), F.lit(protocol["boundary"])),
        "budget": differs(F.col("budget_bytes"), F.lit(protocol["budget_mb"] * 1_000_000)),
        "scalar_grid": F.when(scalar, differs(told, grid)).otherwise(F.size("configuration_fit") > 0),
        "fit_sum": scalar & ~close,
        "result_size": (F.size("clusters") != count) | (F.size("noise") != count),
        **{f"parameter:{c}": differs(F.col(c), w) for c, w in wanted.items()},
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items())))
    identity = F.transform(F.array_sort(F.map_keys(F.map_filter("case_identity", lambda k, v: ~F.element_at("identity", k).eqNullSafe(v)))), lambda k: F.concat(F.lit("identity:"), k))
    every = F.when(F.col("case_case_index").isNull(), F.array(F.lit("unknown_case"))).otherwise(F.concat(found, identity))
    return rows.select("sample_id", F.explode(every).alias("fault"))


def ratios(records: DataFrame) -> DataFrame:
    """(case_id, block, metric, route, value) of (case_id, block, method, route, fit_ms, index, k, l): all ratios of a block.

    `speedup` needs a multi record of 32-bit index. `best_forced` is the faster of the two forced routes.
    """
    one = lambda method, route: F.max(F.when((F.col("method") == method) & (F.col("route") == route), F.col("fit_ms")))
    configs = F.max(F.when(F.col("method") == MULTI, F.col("k") * F.col("l")))
    block = records.groupBy("case_id", "block").agg(one(SEQUENTIAL, NO_ROUTE).alias("sequential"), one(BASELINE, NO_ROUTE).alias("baseline"), one(MULTI, "annotated").alias("annotated"), one(MULTI, "dense").alias("dense"), one(MULTI, "auto").alias("auto"), configs.alias("configs"))
    part = lambda metric, route, value: F.struct(F.lit(metric).alias("metric"), (F.lit(route) if isinstance(route, str) else route).alias("route"), value.alias("value"))
    own = records.where(F.col("method") == MULTI).select("case_id", "block", "route", F.col("fit_ms").alias("own"), "index").join(block, ["case_id", "block"])
    gain = F.col("sequential") / F.col("own")
    speedup = F.when(F.col("index") == "int32", F.col("baseline") / F.col("own"))
    each = own.select("case_id", "block", F.explode(F.array(part("gain", F.col("route"), gain), part("efficiency", F.col("route"), gain / F.col("configs")), part("speedup", F.col("route"), speedup))).alias("x"))
    best = F.when(F.col("annotated").isNotNull() & F.col("dense").isNotNull(), F.least("annotated", "dense"))
    won = F.when(F.col("auto").isNotNull(), F.col("sequential") / best)
    routes = [part("annotated_vs_dense", "annotated", F.col("dense") / F.col("annotated")), part("auto_efficiency", "auto", best / F.col("auto")), part("gain", "best_forced", won), part("efficiency", "best_forced", won / F.col("configs"))]
    return each.unionByName(block.select("case_id", "block", F.explode(F.array(*routes)).alias("x"))).select("case_id", "block", "x.*").where("value is not null")


def paired(rows: DataFrame) -> DataFrame:
    """(case_id, metric, route, pair, value, forward, reverse): both directions of a pair as their geometric mean.

    A pair without just one forward (even) and one reverse (odd) block, or with a ratio that is not positive and finite,
    is an error where the result is read.
    """
    side = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("value")))
    one = lambda odd: F.count_if(F.col("block") % 2 == odd) == 1
    got = rows.groupBy("case_id", "metric", "route", F.expr("cast(block div 2 as int)").alias("pair"))
    got = got.agg(side(0).alias("forward"), side(1).alias("reverse"), (one(0) & one(1) & (F.count("*") == 2)).alias("whole"), F.every((F.col("value") > 0) & (F.col("value") < float("inf"))).alias("fine"))
    where = F.concat_ws("/", "case_id", "metric", "route", F.col("pair").cast("string"))
    fault = F.when(~F.col("whole"), F.concat(where, F.lit(": needs one forward and one reverse block"))).when(~F.coalesce("fine", F.lit(False)), F.concat(where, F.lit(": ratio is not positive and finite")))
    value = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.exp((F.ln("forward") + F.ln("reverse")) / 2))
    return got.select("case_id", "metric", "route", "pair", value.alias("value"), "forward", "reverse")


def excluded(records: DataFrame, cases: DataFrame, samples: int) -> DataFrame:
    """(case_id, reason, n_expected, n_observed): cases that the summary leaves out whole.

    Reasons: failed (a record is not ok), incomplete (an axis is missing or too many), undeclared.
    """
    blocks = F.sequence(F.lit(0), F.lit(samples - 1))
    expected = cases.select("case_id", F.explode(blocks).alias("block"), "routes").select("case_id", "block", F.explode(methods(F.col("routes"))).alias("x")).select("case_id", "block", "x.*")
    seen = records.groupBy(*AXES).agg(F.count_if(~F.col("ok")).alias("bad"))
    both = expected.withColumn("planned", F.lit(True)).join(seen.withColumn("seen", F.lit(True)), AXES, "full")
    got = both.groupBy("case_id").agg(F.count("planned").alias("n_expected"), F.count("seen").alias("n_observed"), F.count_if(F.col("planned").isNull() | F.col("seen").isNull()).alias("off"), F.sum("bad").alias("bad"))
    reason = F.when(F.col("n_expected") == 0, "undeclared").when(F.col("bad") > 0, "failed").when(F.col("off") > 0, "incomplete")
    return got.select("case_id", reason.alias("reason"), "n_expected", "n_observed").where("reason is not null")


def complete(records: DataFrame, cases: DataFrame, samples: int) -> DataFrame:
    """The records of complete cases. Repeated axes and parameters that differ within a case are errors."""
    if not stats.duplicates(records, AXES).isEmpty():
        raise ValueError("a case, block, method and route are recorded twice")
    fixed = [c for c in PARAMETERS if c not in ("seed", "index")]
    index = F.count_distinct(F.when(F.col("index") != OWN_INDEX, F.col("index")))
    differs = records.groupBy("case_id").agg(F.count_distinct(F.to_json(F.struct(*fixed))).alias("n"), index.alias("i")).where("n > 1 or i > 1")
    if (row := differs.first()) is not None:
        raise ValueError(f"{row.case_id}: parameters differ between its records")
    return records.join(excluded(records, cases, samples).select("case_id"), "case_id", "left_anti")


def summary(records: DataFrame, cases: DataFrame, samples: int, resamples: int = stats.RESAMPLES) -> DataFrame:
    """(case_id, kind, name, n, median, ..., iqr, low, high, conclusive): times, densities and paired ratios of complete cases.

    kind: fit_ms and density by method and route, paired_ratio by metric and route. Intervals are seeded by
    `case:name:kind`, so they repeat; fewer than five values are inconclusive.
    """
    kept = complete(records, cases, samples)
    name = F.concat_ws(":", "method", "route")
    parts = [kept.select("case_id", F.lit("fit_ms").alias("kind"), name.alias("name"), F.col("block").alias("o"), F.col("fit_ms").alias("x"))]
    parts.append(kept.where("density is not null").select("case_id", F.lit("density"), name, "block", F.col("density").cast("double")))
    bare = F.col("metric").isin("annotated_vs_dense", "auto_efficiency")
    parts.append(paired(ratios(kept)).select("case_id", F.lit("paired_ratio"), F.when(bare, F.col("metric")).otherwise(F.concat_ws(":", "metric", "route")), "pair", "value"))
    rows = parts[0].union(parts[1]).union(parts[2])
    short = F.when(F.col("kind") == "fit_ms", "fit").when(F.col("kind") == "paired_ratio", "ratio").otherwise(F.col("kind"))
    keys = ["case_id", "kind", "name"]
    intervals = stats.bootstrap(rows.withColumn("seed", F.concat_ws(":", "case_id", "name", short)), keys, "x", "o", resamples, "seed")
    return stats.descriptive(rows, keys, "x").join(intervals.drop("n"), keys)
