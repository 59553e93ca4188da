import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import stats
from lattica.plans import catalog
from lattica.sources import datasets
from lattica.sources import points as src


def test_raw_points_and_labels(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "a.f32").write_bytes(x.tobytes())
    got = src.read_raw(spark, str(tmp_path / "a.f32"), 4, 3).orderBy("id").collect()
    assert [r.v for r in got] == x.tolist()
    with pytest.raises(ValueError):
        src.read_raw(spark, str(tmp_path / "a.f32"), 5, 3)
    labels = np.array([0, -1, 1, 0, 2, -1], "<i4")
    (tmp_path / "l.i32").write_bytes(labels.tobytes())
    read = src.read_labels(spark, str(tmp_path / "l.i32"), 3, 2)
    assert sorted(map(tuple, read.collect())) == [(0, 0, 0), (0, 1, -1), (0, 2, 1), (1, 0, 0), (1, 1, 2), (1, 2, -1)]
    assert src.write_raw_labels(read.repartition(3), f"file://{tmp_path}/labels") >= 1
    parts = sorted((tmp_path / "labels").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == labels.tobytes() and len(list((tmp_path / "labels").glob("_*"))) == 0


def test_several_files_are_one_array(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(25_003, 2)).astype("<f4")
    p = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id bigint, v array<double>").repartition(5)
    n = src.write_raw(p, f"file://{tmp_path}/raw", 3)
    assert n > 1 and b"".join(f.read_bytes() for f in sorted((tmp_path / "raw").glob("part-*"))) == x.tobytes()
    got = src.read_raw(spark, f"file://{tmp_path}/raw/part-*", len(x), 2).orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(x))) and np.array_equal(np.array([r.v for r in got], "f4"), x)
    typed = src.read_typed(spark, f"file://{tmp_path}/raw/part-*", "float32", x.size)
    assert typed.agg({"position": "max"}).first()[0] == x.size - 1
    (tmp_path / "raw" / "part-999999").write_bytes(b"odd")
    with pytest.raises(ValueError):
        src.read_typed(spark, f"file://{tmp_path}/raw/part-*", "float32")


@pytest.mark.parametrize("kind", src.KINDS)
def test_typed_arrays(spark, tmp_path, kind):
    x = np.array([0, 1, 2, 200], src.KINDS[kind][0])
    (tmp_path / "a").write_bytes(x.tobytes())
    assert [r.value for r in src.read_typed(spark, str(tmp_path / "a"), kind, 4).orderBy("position").collect()] == x.tolist()


def test_datasets_are_validated_as_a_whole(spark, tmp_path):
    p = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(6)], "id bigint, v array<double>")
    truth = p.selectExpr("id", "cast(id % 2 as int) as truth")
    protocol = {"name": "v1", "seed": 7, "generator": "g", "eps_quantiles": [0.5, 0.9], "pool_size": 3}
    meta = {"protocol": "v1", "dataset": "x_2d", "seed": 7, "generator": "g", "eps_quantiles": [0.5, 0.9], "eps": [0.1, 0.2], "min_samples": [2, 4]}
    path = f"file://{tmp_path}/d"
    datasets.write_dataset(p, truth, meta, path)
    good = datasets.validate_dataset(spark, path, "x_2d", 6, protocol)
    assert good["eps_pool"] == [0.1, 0.2] and good["minpts_pool"] == [2, 3, 4]
    whole = datasets.metadata(spark, path)
    for change in ({"seed": 8}, {"dtype": "float64"}, {"d": 3}, {"d": True}, {"eps": [0.2, 0.1]}, {"eps": [0.1]}, {"min_samples": []}, {"min_samples": [0]}, {"eps_quantiles": [0.5]}, {"n": 7}, {"generator": "h"}):
        assert datasets.faults(whole | change, protocol, "x_2d", 6), change
    assert datasets.faults(whole, protocol, "x_2d", 6) == [] and datasets.faults(whole, protocol, "y_3d", 6)
    p.withColumn("v", F.when(F.col("id") == 2, F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.col("v"))).write.mode("overwrite").parquet(f"{path}/points")
    with pytest.raises(ValueError, match="points have another hash"):
        datasets.validate_dataset(spark, path, "x_2d", 6, protocol)
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    with pytest.raises(ValueError, match="lacks"):
        datasets.metadata(spark, path)


def test_lookup_of_unknown_data_sets_raises(spark):
    pools = spark.createDataFrame([("a", 1, [0.5, 1.0], [3])], "dataset string, n int, eps_pool array<double>, minpts_pool array<int>")
    cases = spark.createDataFrame([("a", 1, [1], [0])], "dataset string, n int, eps_indices array<int>, minpts_indices array<int>")
    assert [(r.eps, r.min_samples) for r in datasets.lookup(cases, pools).collect()] == [([1.0], [3])]
    for bad in (("a", 2, [0], [0]), ("a", 1, [2], [0])):
        with pytest.raises(Exception, match="no data set"):
            datasets.lookup(spark.createDataFrame([bad], cases.schema), pools).collect()


def test_failure_artifacts_replay_and_notice_changes(spark, tmp_path):
    p = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id bigint, v array<double>")
    labels = spark.createDataFrame([(0, 0, 0), (0, 1, -1)], "config int, id bigint, label int")
    at = src.write_failure(p, labels, {"case": "x"}, f"file://{tmp_path}")
    q, back, manifest = src.read_failure(spark, at)
    assert manifest["case"] == "x" and q.count() == 2 and back.count() == 2
    p.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/points/{manifest['points']}")
    with pytest.raises(ValueError):
        src.read_failure(spark, at)


def test_paired_ratios_and_routes(spark):
    rows = [("a", b, m, v) for b, vs in ((0, (10.0, 20.0, 30.0)), (1, (20.0, 30.0, 36.0))) for m, v in zip(("multi", "sequential", "baseline"), vs, strict=True)]
    got = stats.block_ratios(spark.createDataFrame(rows, "case_id string, block int, method string, fit_ms double"))
    pair = stats.paired_ratios(got.selectExpr("case_id", "block div 2 as pair", "gain as ratio"), ["case_id", "pair"]).collect()
    assert [round(r.ratio, 9) for r in pair] == [round(3**0.5, 9)]
    other = stats.paired_ratios(got.selectExpr("case_id", "block div 2 as pair", "speedup as ratio"), ["case_id", "pair"]).first()
    assert round(other.ratio, 9) == round(5.4**0.5, 9)


def test_ratios_that_are_no_pair_raise(spark):
    for rows in ([("a", 1.0)], [("a", 1.0), ("a", -2.0)], [("a", 1.0), ("a", float("inf"))], [("a", 1.0), ("a", 2.0), ("a", 3.0)], [("a", 1.0), ("a", None)]):
        with pytest.raises(Exception, match="two positive finite ratios"):
            stats.paired_ratios(spark.createDataFrame(rows, "k string, ratio double"), ["k"]).collect()


def test_descriptive_of_one_value_and_bootstrap(spark):
    one = stats.descriptive(spark.createDataFrame([("a", 2.0)], "k string, x double"), ["k"], "x").first()
    assert one.stddev == 0.0 and one.median == 2.0 and one.iqr == 0.0
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "k string, o int, x double")
    a, b = (stats.bootstrap(rows.repartition(k), ["k"], "x", "o", 200).first() for k in (1, 3))
    assert a == b and a.conclusive and 0 <= a.low <= 2.5 <= a.high <= 5


def test_bootstrap_query_as_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    cases: dict[str, list] = {}
    for r in stats.block_ratios(catalog.records(spark, sf)).orderBy("block").collect():
        cases.setdefault(r.case_id, []).append(r.gain)
    want = {}
    for case, gains in cases.items():
        draw = random.Random(int.from_bytes(hashlib.sha256(case.encode()).digest()[:8], "big"))
        medians = [statistics.median([gains[draw.randrange(len(gains))] for _ in gains]) for _ in range(10_000)]
        want[case] = [len(gains), *np.percentile(medians, [2.5, 97.5]), len(gains) >= 5]
    got = {r.case_id: [r.n, r.low, r.high, r.conclusive] for r in catalog.QUERIES["bootstrap_ci"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
