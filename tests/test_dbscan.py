import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import vectors
from lattica.operators import canonical, dbscan, degrees, forest, pairs, validate
from lattica.sources import synthetic
from lattica.sources.stored import written


def frame(spark, x):
    x = np.asarray(x, np.float64)
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id bigint, v array<double>").repartition(3)


def cells(fit):
    """clusters/core/border/noise/ambiguous of each configuration."""
    labels = fit.labels()
    base = {r.config: r for r in dbscan.summary(labels).collect()}
    amb = {r.config: r.n for r in validate.structure(fit).groupBy("config").agg(F.count_if("ambiguous").alias("n")).collect()}
    n = fit.points.count()
    return [(r.n_clusters, r.n_core, n - r.n_core - r.n_noise, r.n_noise, amb[c]) for c, r in sorted(base.items())]


def brute(x, eps, m):
    x = np.asarray(x, np.float64)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= m
    root = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = root.copy()
        for i in np.flatnonzero(core):
            new[i] = root[near[i] & core].min()
        if (new == root).all():
            break
        root = new
    for i in np.flatnonzero(~core):
        beside = root[near[i] & core]
        root[i] = beside.min() if len(beside) else -1
    firsts = sorted({int(np.flatnonzero(root == r)[0]) for r in set(root.tolist()) - {-1}})
    number = {int(root[f]): k for k, f in enumerate(firsts)}
    return [number.get(int(r), -1) for r in root]


UNIT = [(-0.9, 0), (-1.1, 0), (-1.1, 0.1), (-1.1, -0.1), (0.9, 0), (1.1, 0), (1.1, 0.1), (1.1, -0.1), (0, 0)]
LEFT = [(-0.50, 0), (-0.80, 0), (-0.80, 0.05), (-0.80, -0.05), (-0.85, 0), (-0.75, 0)]


def test_unit_fixture_over_a_rectangular_grid(spark):
    fit = dbscan.fit(frame(spark, UNIT), [0.25, 1.0, 2.5], [2, 3, 4, 6])
    assert cells(fit) == [(2, 8, 0, 1, 0)] * 3 + [(0, 0, 0, 9, 0)] + [(1, 9, 0, 0, 0)] * 2 + [(2, 8, 1, 0, 1), (0, 0, 0, 9, 0)] + [(1, 9, 0, 0, 0)] * 4


def test_ambiguous_border(spark):
    x = [*LEFT, (0, 0), *[(-a, b) for a, b in LEFT]]
    got = cells(dbscan.fit(frame(spark, x), [0.49, 0.51], [4, 5, 7]))
    assert got == [(2, 12, 0, 1, 0), (2, 12, 0, 1, 0), (0, 0, 0, 13, 0), (2, 12, 1, 0, 1), (2, 12, 1, 0, 1), (2, 2, 11, 0, 1)]


def test_balls_are_closed_and_duplicates_count(spark):
    one = float(np.float32(1.0))
    below, above = float(np.nextafter(np.float32(1), np.float32(0))), float(np.nextafter(np.float32(1), np.float32(2)))
    got = cells(dbscan.fit(frame(spark, [[0], [1], [10], [11]]), [below, one, above], [2, 3]))
    assert got == [(0, 0, 0, 4, 0)] * 2 + [(2, 4, 0, 0, 0), (0, 0, 0, 4, 0)] * 2
    assert cells(dbscan.fit(frame(spark, np.zeros((32, 2))), [0.1], [1, 32, 33])) == [(1, 32, 0, 0, 0)] * 2 + [(0, 0, 0, 32, 0)]


def test_all_routes_and_both_ways_of_components_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (1, 0), (0, 1))] + [rng.uniform(-1, 2, (8, 2))])
    eps, counts = [0.1, 0.2, 0.35], [3, 5, 9]
    want = {(k * 3 + q, i): v for k, e in enumerate(eps) for q, m in enumerate(counts) for i, v in enumerate(brute(x, e, m))}
    for route, links in (("broadcast", 10**6), ("blocks", 10**6), ("grid", 10**6), ("expressions", 10**6), ("broadcast", 0)):
        got = {(r.config, r.id): r.label for r in dbscan.fit(frame(spark, x), eps, counts, route, links).labels().collect()}
        assert got == want, (route, links)


def test_pairs_of_blocks_smaller_than_the_data(spark):
    x = np.random.default_rng(0).normal(0, 1, (60, 3))
    p = frame(spark, x)
    few = pairs.by_blocks(p, [0.5, 1.0], 60, 3, block_rows=16)
    assert sorted(map(tuple, few.select("i", "j", "code").collect())) == sorted(map(tuple, pairs.by_expressions(p, [0.5, 1.0]).select("i", "j", "code").collect()))


def test_bad_points_are_refused(spark):
    for rows in ([(0, [0.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(0, [1.0]), (0, [2.0])]):
        with pytest.raises(ValueError):
            vectors.check(spark.createDataFrame(rows, "id bigint, v array<double>"))


def test_knn_blocks_as_broadcast(spark):
    p = frame(spark, np.random.default_rng(1).normal(0, 1, (50, 4)))
    key = lambda df: sorted((r.id, r.rank, r.neighbour, round(r.dist, 9)) for r in df.collect())
    assert key(pairs._knn_blocks(p, 5, 50)) == key(pairs.knn(p, 5))


@pytest.mark.parametrize("x", [np.random.default_rng(4).normal(0, 0.1, (90, 3)) + 1e6, np.repeat(np.arange(6.0), 15)[:, None] * 1e25, np.random.default_rng(4).normal(0, 1e-25, (90, 2))], ids=["far", "huge copies", "tiny"])
def test_products_lose_no_neighbour(x):
    ids = np.random.default_rng(1).permutation(270)[: len(x)].astype(np.int64)
    d2 = sum((x[:, c][:, None] - x[:, c][None]) ** 2 for c in range(x.shape[1]))
    want = [[i, r, ids[j], np.sqrt(d2[a, j])] for a, i in enumerate(ids) for r, j in enumerate(np.lexsort((ids, d2[a], ids != i))[:7])]
    assert [list(r) for r in zip(*(c.to_pylist() for c in pairs.nearest(ids, x, ids, x, 7).columns), strict=True)] == want
    e = float(np.sqrt(np.quantile(d2, 0.3)))
    found = sorted((i, j) for b in pairs.near(ids, x, ids, x, [e]) for i, j in zip(b["i"].to_pylist(), b["j"].to_pylist(), strict=True))
    assert found == sorted((i, j) for a, i in enumerate(ids) for b, j in enumerate(ids) if i < j and d2[a, b] <= e * e)


def test_neighbours_among_many_are_found_by_products():
    x = np.random.default_rng(0).normal(0, 1, (40_000, 64))
    began = time.process_time()
    assert pairs.nearest(np.arange(300), x[:300], np.arange(40_000), x, 21).num_rows == 6300
    assert time.process_time() - began < 9  # differences of all columns took 146 ms a row at 100 000 columns


def test_a_search_holds_no_copy_of_the_other_block():
    y = np.random.default_rng(3).uniform(0, 1, (120_000, 32))
    ids = np.arange(120_000)
    tracemalloc.start()
    try:
        found = sorted((i, j) for b in pairs.near(ids[::1200], y[::1200], ids, y, [1.3, 1.4]) for i, j in zip(b["i"].to_pylist(), b["j"].to_pylist(), strict=True))
        assert tracemalloc.get_traced_memory()[1] < y.nbytes
    finally:
        tracemalloc.stop()
    want = [(i, int(j)) for i in range(0, 120_000, 1200) for j in i + 1 + np.flatnonzero(((y[i + 1 :] - y[i]) ** 2).sum(1) <= 1.4**2)]
    assert found == want and len(found) > 10


def test_the_nested_loop_needs_no_lambdas(spark):
    x = np.random.default_rng(6).normal(0, 0.1, (40, 64))
    got = pairs.pairs(frame(spark, x), [0.9, 1.1], "expressions")
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if d2[i, j] <= 1.21}
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_validation_finds_each_mutation(spark):
    fit = dbscan.fit(frame(spark, UNIT), [1.0], [4])
    truth, labels = validate.structure(fit), fit.labels().select("config", "id", "label")
    assert validate.violations(truth, labels).isEmpty()
    other = labels.withColumn("label", F.when(F.col("id") == 8, 1).otherwise(F.col("label")))
    assert validate.semantic(truth, labels, other).first().status == validate.BY_BORDER
    for i, value, code in ((1, -1, validate.SPLIT), (8, -1, validate.BORDER), (3, -2, validate.NEGATIVE), (5, 0, validate.SPLIT), (8, 7, validate.FAR)):
        bad = labels.withColumn("label", F.when(F.col("id") == i, value).otherwise(F.col("label")))
        assert code in {r.code for r in validate.violations(truth, bad).collect()}
        assert validate.semantic(truth, labels, bad).first().status == validate.INVALID


def test_canonical_and_ari(spark):
    a = spark.createDataFrame([(0, i, v) for i, v in enumerate([7, 7, -1, 3, 3])], "config int, id bigint, label int")
    b = spark.createDataFrame([(0, i, v) for i, v in enumerate([11, 11, -1, 4, 4])], "config int, id bigint, label int")
    assert [r.label for r in canonical.canonical(a).orderBy("id").collect()] == [0, 0, -1, 1, 1]
    row = canonical.compare(a, b).first()
    assert row.identical and row.ari == 1.0 and row.first_diff is None
    assert canonical.identical(a, b)


def test_degrees_without_pairs(spark):
    p = frame(spark, [[0.0], [10.0]])
    table = pairs.pairs(p, [1.0])
    assert sorted(map(tuple, degrees.degrees(p, table, 1).collect())) == [(0, [1]), (1, [1])]


def test_families_have_their_size_and_do_not_depend_on_partitions(spark):
    for family in ("dense_blobs_noise", "moons", "power_law_blobs", "filaments"):
        got = synthetic.generate(spark, family, 200, 3)
        assert got.count() == 200 and got.agg(F.min(F.size("v"))).first()[0] == 3
    a, b = (synthetic.generate(spark, "uniform", 50, 2).repartition(k).orderBy("id").collect() for k in (1, 7))
    assert a == b


@pytest.mark.parametrize("radius", [0.05, 0.5, 40.0])
def test_blocks_meet_only_those_within_reach(spark, radius):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 30, (150, 2)), np.full((50, 2), 7.0), rng.uniform(0, 30, (1, 2)) * [0, 1]])
    p = frame(spark, x)
    got = pairs.by_blocks(p, [radius], len(x), 2, block_rows=16)
    key = lambda df: sorted(map(tuple, df.select("i", "j").collect()))
    assert key(got) == key(pairs.by_expressions(p, [radius]))
    rows = pairs.blocks(p, radius, len(x), 2, 16).collect()
    sizes = [sum(r.b == b for r in rows) for b in {r.b for r in rows}]
    spans = [r["last"] - r["first"] + 1 for r in rows]
    assert max(sizes) < 48 and (max(spans) <= len(sizes) // 2 if radius < 1 else min(spans) == len(sizes))


def test_blocks_of_nothing(spark):
    p = frame(spark, np.zeros((1, 2))).where("id > 5")
    assert pairs.by_blocks(p, [1.0], 0, 2).isEmpty()


def test_a_search_over_its_budget_is_refused(spark):
    x = np.random.default_rng(2).normal(0, 0.01, (400, 2))
    p = frame(spark, x)
    with pytest.raises(pairs.TooManyPairs, match="budget of 1000"):
        dbscan.fit(p, [1.0], [4], max_pairs=1000)
    assert dbscan.fit(p, [1e-9], [4], max_pairs=1000).table.isEmpty()
    assert pairs.estimate(p, 1.0, 400) == 400 * 399 / 2
    assert 0.7 < pairs.estimate(p, 1.0, 400, asked=60) / (400 * 399 / 2) <= 1.01


def test_cost_predicate(spark):
    rows = [(4_000_000, 16_000_000, 6, 2, True), (13_400_000, 64_000**2, 6, 64, True), (72_000_000, 16_000**2, 2, 64, False), (1_170_000_000, 64_000**2, 2, 64, False)]
    got = spark.createDataFrame(rows, "nnz bigint, searched bigint, n_eps int, d int, pays boolean")
    assert got.where(pairs.one_search_pays(F.col("nnz"), F.col("searched"), F.col("n_eps"), F.col("d")) != F.col("pays")).isEmpty()


def _blobs(rng, parts):
    return np.concatenate([rng.normal(c, sd, (n, 2)).astype(np.float32) for c, n, sd in parts])


def _two(seed, n, sd):
    return _blobs(np.random.default_rng(seed), [((-1.0, 0.0), n, sd), ((1.0, 0.0), n, sd)])


def _wide(base, d):
    out = np.zeros((len(base), d), np.float32)
    out[:, : min(2, d)] = base[:, : min(2, d)]
    return out


def _lines(d):
    out = np.zeros((24, d), np.float32)
    out[:12, 0], out[12:, 0] = np.linspace(-1.05, -0.95, 12), np.linspace(0.95, 1.05, 12)
    return out


def _random(seed):
    rng = np.random.default_rng(10_000 + seed)
    return np.concatenate([_blobs(rng, [((-1.0, -0.2), 20, 0.10), ((0.0, 1.0), 20, 0.10), ((1.0, -0.2), 20, 0.10)]), rng.uniform(-1.5, 1.5, (8, 2)).astype(np.float32)])


_TENTH = [float(np.nextafter(np.float32(0.1), np.float32(-np.inf))), 0.1, float(np.nextafter(np.float32(0.1), np.float32(np.inf)))]
_FLAT = [(2, 39, 0, 1, 0), (2, 37, 2, 1, 0), (2, 40, 0, 0, 0), (2, 39, 1, 0, 0), (2, 40, 0, 0, 0), (2, 40, 0, 0, 0)]
ADVERSARIAL = {
    "all_noise_1d": (np.arange(24.0)[:, None] * 10, [0.1, 1.0], [2, 4], [(0, 0, 0, 24, 0)] * 4),
    "one_cluster_duplicates_2d": (np.zeros((32, 2)), _TENTH, [1, 8, 32, 33], ([(1, 32, 0, 0, 0)] * 3 + [(0, 0, 0, 32, 0)]) * 3),
    "dimension_1": (_wide(_two(2026, 20, 0.05), 1), [0.08, 0.18, 0.40], [3, 6], [(2, 40, 0, 0, 0)] * 6),
    **{f"dimension_{d}": (_wide(_two(2026, 20, 0.05), d), [0.08, 0.18, 0.40], [3, 6], _FLAT) for d in (2, 16, 33)},
    "high_dimension_8193": (_lines(8193), [0.03, 0.15], [2, 5], [(2, 24, 0, 0, 0), (2, 20, 4, 0, 0), (2, 24, 0, 0, 0), (2, 24, 0, 0, 0)]),
    "forced_batches_2d": (_two(3000, 500, 0.08), [0.04, 0.10], [4, 12], [(2, 970, 9, 21, 0), (2, 844, 93, 63, 0), (2, 1000, 0, 0, 0), (2, 995, 5, 0, 0)]),
    "random_seed_000": (_random(0), [0.10], [3, 5, 9, 15], [(5, 49, 5, 14, 0), (4, 41, 10, 17, 0), (2, 5, 20, 43, 0), (0, 0, 0, 68, 0)]),
}


@pytest.mark.parametrize("name", ADVERSARIAL)
def test_adversarial_points(spark, name):
    x, eps, counts, want = ADVERSARIAL[name]
    route = {"forced_batches_2d": "blocks", "high_dimension_8193": "blocks"}.get(name, "auto")
    assert cells(dbscan.fit(frame(spark, x), eps, counts, route)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_points_by_brute_force(spark, seed):
    x, eps, counts = _random(seed), [0.10, 0.20, 0.35], [3, 5, 9, 15]
    fit = dbscan.fit(frame(spark, x), eps, counts)
    got = {(r.config, r.id): r.label for r in fit.labels().collect()}
    assert got == {(k * 4 + q, i): v for k, e in enumerate(eps) for q, m in enumerate(counts) for i, v in enumerate(brute(x, e, m))}


def test_clusters_are_numbered_alike_in_many_tasks(spark, monkeypatch):
    x = np.arange(60.0).repeat(3)[:, None]
    fit = dbscan.fit(frame(spark, x), [0.1, 1.0], [2, 4])
    one = sorted(map(tuple, fit.labels().collect()))
    monkeypatch.setattr(dbscan, "LOCAL_CLUSTERS", 0)
    assert sorted(map(tuple, fit.labels().collect())) == one


def test_copies_are_searched_once(spark):
    x = np.repeat(_random(4), 4, 0)[np.random.default_rng(9).permutation(272)]
    eps, counts = [0.06, 0.10, 0.20], [3, 8, 24, 40]
    fit = dbscan.fit(frame(spark, x), eps, counts)
    got = {(r.config, r.id): r.label for r in fit.labels().collect()}
    assert got == {(k * 4 + q, i): v for k, e in enumerate(eps) for q, m in enumerate(counts) for i, v in enumerate(brute(x, e, m))}
    near = [(((x[:, None] - x[None]) ** 2).sum(2) <= e * e).sum(1) for e in eps]
    truth = validate.structure(fit)
    assert {(r.config, r.id): r.degree for r in truth.collect()} == {(k * 4 + q, i): int(v) for k in range(3) for q in range(4) for i, v in enumerate(near[k])}
    assert validate.violations(truth, fit.labels()).isEmpty()
    assert fit.table.count() < 68 * 67 / 2 and fit.table.where("d2 = 0").isEmpty()


def test_a_task_leaves_a_forest_of_all_its_pairs(spark, monkeypatch):
    x, eps, counts = np.random.default_rng(11).uniform(0, 1, (300, 2)), [0.1, 0.15, 0.3], [3, 9, 20]
    fit = dbscan.fit(frame(spark, x), eps, counts)
    monkeypatch.setattr(forest, "SOME", 100)
    left = forest.shared(fit.table.repartition(1), fit.core, 3)
    assert fit.table.count() > 3000 and left.groupBy("mp_idx").count().where("count > 299").isEmpty()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(forest.from_forest(fit.core, left, 3)) == key(fit.roots) == key(forest.from_forest(fit.core, forest.core_links(fit.table, fit.core), 3))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_border_assignment_has_no_row_for_each_pair_and_configuration(spark):
    fit = dbscan.fit(frame(spark, _random(3)), [0.1, 0.2, 0.35], [3, 5, 9])
    plan = fit._beside()._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Join Cross" not in plan
    late = fit._beside().count()
    assert late < 2 * fit.table.count() * 9 / 3


def test_a_matrix_of_sources_is_a_small_plan(spark):
    x = [0, 0.3, 0.7, 1.0, 1.3, 1.6, 2.0, 2.3, 1.15, 9]
    fit = dbscan.fit(frame(spark, np.array(x)[:, None]), [0.31, 0.45], [3, 4])
    truth, own = written(validate.structure(fit), "structure"), written(fit.labels().select("config", "id", "label"), "labels")
    twice = own.union(own.where("config = 2 and id = 4"))
    sources = {"a": own, "b": own.withColumn("label", F.when(F.col("label") < 0, -1).otherwise(9 - F.col("label"))), "c": twice.where("config != 1 or id != 9")}
    rows = None
    for name, labels in sources.items():
        part = labels.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    got = validate.matrix(truth, rows)
    want = {(*p, c): validate.INVALID if "c" in p and c in (1, 2) else validate.SAME for p in ("ab", "ac", "bc") for c in range(4)}
    assert {(r.source_a, r.source_b, r.config): r.status for r in got.collect()} == want
    assert {(r.config, r.code, r.id) for r in validate.violations(truth, twice).collect()} == {(2, validate.SHAPE, None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_monotonicity_finds_planted_faults(spark):
    fit = dbscan.fit(frame(spark, UNIT), [0.25, 1.0], [2, 3, 4])
    rows = spark.createDataFrame([(c, n) for c, n in enumerate([1, 2, 0, 3, 1, 1])], "config int, n_noise bigint")
    got = sorted(map(tuple, validate.monotonicity(rows, fit.configurations).collect()))
    assert got == [("eps", 3, 3, 1), ("eps", 5, 1, 0), ("min_pts", 2, 0, 2), ("min_pts", 4, 1, 3)]
