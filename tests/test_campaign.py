import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import campaign
from lattica.plans import campaign as plans

SF = "/root/testdata/sf0.001"
#: Times of two blocks, forward and reverse, and the ratios that follow from them.
TIMES = {"multi:auto": (10.0, 20.0), "multi:annotated": (12.0, 15.0), "multi:dense": (11.52, 15.0), "sequential:not-applicable": (20.0, 30.0), "baseline:not-applicable": (30.0, 36.0)}


def records(spark, times=TIMES, blocks=2, **change):
    rows = [("a", b, *m.split(":"), t[b % 2], "int32" if "multi" in m or "seq" in m else campaign.OWN_INDEX) for m, t in times.items() for b in range(blocks)]
    got = spark.createDataFrame(rows, "case_id string, block int, method string, route string, fit_ms double, index string")
    fixed = {"dataset": F.lit("x"), "n": F.lit(9), "d": F.lit(2), "k": F.lit(2), "l": F.lit(2), "seed": F.lit(1), "eps": F.array(F.lit(0.5)), "min_samples": F.array(F.lit(2)), "tier": F.lit("core"), "density": F.lit(0.25), "ok": F.lit(True)}
    return got.withColumns(fixed | change)


def cases(spark):
    return spark.createDataFrame([("a", ["auto", "annotated", "dense"])], "case_id string, routes array<string>")


def test_paired_ratios_of_a_block_pair(spark):
    got = {(r.metric, r.route): r.value for r in campaign.paired(campaign.ratios(records(spark))).collect()}
    assert got["gain", "auto"] == pytest.approx(3**0.5) and got["speedup", "auto"] == pytest.approx(5.4**0.5)
    assert got["annotated_vs_dense", "annotated"] == pytest.approx(0.96**0.5) and got["efficiency", "auto"] == pytest.approx(3**0.5 / 4)
    assert got["gain", "best_forced"] == pytest.approx((20 / 11.52 * 2) ** 0.5) and len(got) == 3 * 3 + 4
    wide = campaign.ratios(records(spark).withColumn("index", F.lit("int64")))
    assert wide.where("metric = 'speedup'").isEmpty()


def test_broken_pairs_and_ratios_raise(spark):
    with pytest.raises(Exception, match="one forward and one reverse"):
        campaign.paired(campaign.ratios(records(spark).where("block = 0"))).collect()
    with pytest.raises(Exception, match="not positive and finite"):
        campaign.paired(campaign.ratios(records(spark, TIMES | {"sequential:not-applicable": (20.0, -1.0)}))).collect()


def test_duplicates_and_differing_parameters_raise(spark):
    own = records(spark)
    with pytest.raises(ValueError, match="twice"):
        campaign.summary(own.union(own.limit(1)), cases(spark), 2)
    with pytest.raises(ValueError, match="differ"):
        campaign.summary(own.withColumn("n", F.when(F.col("method") == "baseline", 8).otherwise(9)), cases(spark), 2)
    with pytest.raises(ValueError, match="differ"):
        campaign.summary(own.withColumn("index", F.when(F.col("route") == "dense", "int64").otherwise(F.col("index"))), cases(spark), 2)


def test_incomplete_failed_and_undeclared_cases_go_whole(spark):
    own = records(spark)
    assert campaign.excluded(own, cases(spark), 2).isEmpty()
    reason = lambda rows, plan, n: [r.reason for r in campaign.excluded(rows, plan, n).collect()]
    assert reason(own, cases(spark), 3) == ["incomplete"] and reason(own, cases(spark), 1) == ["incomplete"]
    assert reason(own.withColumn("ok", F.col("route") != "dense"), cases(spark), 2) == ["failed"]
    assert reason(own, cases(spark).withColumn("case_id", F.lit("b")).union(cases(spark).where("1 = 0")), 2).count("undeclared") == 1
    assert campaign.summary(own, cases(spark), 3).isEmpty()


def test_summary_and_its_intervals_by_plain_python(spark):
    blocks = 12
    got = {(r.kind, r.name): r for r in campaign.summary(records(spark, blocks=blocks), cases(spark), blocks, 2000).collect()}
    assert {k for k, _ in got} == {"fit_ms", "density", "paired_ratio"}
    row = got["fit_ms", "multi:auto"]
    values = [10.0, 20.0] * 6
    draw = random.Random(int.from_bytes(hashlib.sha256(b"a:multi:auto:fit").digest()[:8], "big"))
    medians = [statistics.median([values[draw.randrange(12)] for _ in values]) for _ in range(2000)]
    assert (row.n, row["median"], row.conclusive) == (12, 15.0, True) and [row.low, row.high] == pytest.approx(np.percentile(medians, [2.5, 97.5]).tolist())
    ratio = got["paired_ratio", "gain:auto"]
    assert ratio.n == 6 and ratio.low == pytest.approx(3**0.5) == pytest.approx(ratio.high)
    assert got["density", "multi:dense"].stddev == 0 and ("paired_ratio", "auto_efficiency") in got


def test_each_planted_fault_of_a_record_is_told(spark):
    found = {r.fault for r in plans.record_axes(spark, SF).collect()}
    assert found == {"unknown_case", "direction", "parameter:n", "fit_sum", "identity:binary", "result_size", "budget", "sample_id", "order"}


def test_queries_as_in_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("customer", "embeddings", "events", "lineitem", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("dataset_lookup", "io_raw_labels", "io_records", "paired_metric_ratios", "excluded_cases", "record_axes"):
        got = plans.QUERIES[name](spark, SF)
        want = db.execute(f"select {', '.join(got.columns)} from ({plans.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
