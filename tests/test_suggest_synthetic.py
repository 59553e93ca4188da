import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import suggest, vectors
from lattica.operators import canonical, dbscan, validate
from lattica.sources import points as src
from lattica.sources import synthetic


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def kth(x, k):
    return np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, k]


def test_samples_do_not_depend_on_partitions(spark):
    p = frame(spark, np.random.default_rng(0).normal(size=(200, 2)))
    a, b = ({r.id for r in suggest.sample(p.repartition(k), 50, 200, 3).collect()} for k in (1, 7))
    assert a == b and len(a) == 50 and a != {r.id for r in suggest.sample(p, 50, 200, 4).collect()}
    assert suggest.sample(p, 500, 200).count() == 200


def test_radii_from_a_sample_and_without_noise(spark):
    x = np.random.default_rng(1).normal(size=(200, 3))
    p = frame(spark, x)
    cut = lambda d: [float(np.float32(q)) for q in np.quantile(d, suggest.QUANTILES)]
    assert suggest.eps(p, 5).first().eps == pytest.approx(cut(kth(x, 4)))
    ids = sorted(r.id for r in suggest.sample(p, 60, 200).collect())
    rank = suggest.sampled_rank(200, 60, 21)
    assert rank == 7 and suggest.eps(p, 21, sample_size=60).first().eps == pytest.approx(cut(kth(x[ids], rank - 1)))
    noisy = p.select("id", F.when(F.col("id") < 100, -1).otherwise(1).alias("truth"))
    assert suggest.eps(p, 5, truth=noisy).first().eps == pytest.approx(cut(kth(x, 4)[100:]))
    mostly = p.select("id", F.when(F.col("id") < 160, -1).otherwise(1).alias("truth"))  # 40 rows are too few
    assert suggest.eps(p, 5, truth=mostly).first().eps == pytest.approx(cut(kth(x, 4)))
    assert suggest.eps(frame(spark, np.zeros((20, 2))), 4).first().eps == [float(np.float32(suggest.FLOOR))]


def test_intrinsic_dimension_of_a_plane_and_of_too_few_points(spark):
    plane = np.zeros((400, 6))
    plane[:, :2] = np.random.default_rng(2).uniform(size=(400, 2))
    assert suggest.intrinsic_dimension(frame(spark, plane)).first().dim == pytest.approx(2, abs=0.4)
    assert suggest.intrinsic_dimension(frame(spark, plane[:3])).first().dim == 6.0
    got = suggest.grid(frame(spark, plane))
    assert got["min_pts"] == suggest.min_pts(400, got["dim"]) and got["eps"] == sorted(got["eps"])


def test_widening_repeats_features(spark):
    got = vectors.widen(frame(spark, [[0.5, 2.0]]), 10, noise=0.0).first().v
    x, y = 0.5, 2.0
    made = [x, y, x + y, x - y, math.sin(x), math.cos(y), x * y, x * x - y * y]
    assert got == pytest.approx([*made, made[0] * 1.1, made[1] * 1.1])


def test_three_blobs_and_every_family(spark):
    got = synthetic.three_blobs(spark, 300, 4)
    assert [r.v[2:] for r in got.limit(3).collect()] == [[0.0, 0.0]] * 3
    assert dbscan.summary(dbscan.fit(got, [0.4], [5]).labels()).first().n_clusters == 3
    for family in synthetic.FAMILIES:
        made = synthetic.generate(spark, family, 64, 3)
        assert made.count() == 64 and made.where(~vectors.is_finite(F.col("v"))).isEmpty() and made.agg(F.count_distinct("id")).first()[0] == 64, family


def test_presets_and_centres():
    assert len(synthetic.planned("artigo")) == 5 * 8 * 8 and len(synthetic.planned("estresse")) == 6 * 3 * 8
    assert np.array_equal(synthetic.centers(4, 3, 4.5), synthetic.centers(4, 3, 4.5)) and synthetic.centers(4, 3, 4.5).shape == (3, 4)
    with pytest.raises(ValueError):
        synthetic.parts("nothing", 10, 2, 1)


def test_labels_as_a_table_and_policies(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (0, 2, -1), (0, 1, 3)], "config int, id bigint, label int")
    src.write_labels(labels, f"file://{tmp_path}/l")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/l").collect())) == [(0, 1, 3), (0, 2, -1), (1, 1, 0)]
    assert validate.policy("always", 10**9) and not validate.policy("never", 1) and validate.policy("auto", 20_000) and not validate.policy("auto", 20_001)
    with pytest.raises(ValueError):
        validate.policy("sometimes", 1)
    assert canonical.identical(labels, labels.withColumn("label", F.when(F.col("label") >= 0, F.col("label") + 7).otherwise(-1)))
    with pytest.raises(ValueError):
        validate.matrix(labels, labels.withColumn("source", F.lit("one")))
