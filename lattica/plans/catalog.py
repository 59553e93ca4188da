"""All registered queries of the clustering engine and their SQL. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import grid, stats, suggest, vectors
from lattica.operators import canonical, dbscan, degrees, forest, pairs, validate
from lattica.plans import oracles as sql
from lattica.sources import points as src
from lattica.sources import synthetic
from lattica.sources.stored import written

EPS, MIN_PTS = [1.10, 1.14, 1.18], [3, 4, 8]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "c1":
        return src.from_columns(_table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")
    if name == "p2":
        return vectors.min_max(src.from_columns(_table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice"), 2)
    return src.from_array(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None if name == "e64" else int(name[1:]))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements that the events stand for; see oracles.RECORDS."""
    e = _table(spark, sf_dir, "events")
    method = F.element_at(F.array(*map(F.lit, ("multi", "sequential", "baseline"))), (F.expr("(event_id div 120) % 3") + 1).cast("int"))
    return e.groupBy(F.concat(F.lit("c"), (F.col("event_id") % 20).cast("string")).alias("case_id"), F.expr("cast((event_id div 20) % 6 as int)").alias("block"), method.alias("method")).agg((10 + F.avg(F.abs("value"))).alias("fit_ms"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.summary(dbscan.fit(points(spark, sf_dir, "e64"), EPS, MIN_PTS).labels())


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


# points and pairs


@query(f"with pts as ({sql.POINTS['e64'][0]}) select count(*) as n, max(len(v)) as d, min(len(v)) = max(len(v)) as even, bool_and(len(list_filter(v, lambda x: not isfinite(x))) = 0) as finite, count(distinct id) = count(*) as distinct_ids from pts")
def points_checks(spark, sf_dir):
    return vectors.checks(points(spark, sf_dir, "e64"))


@query(f"with pts as ({sql.POINTS['p2'][0]}) select id, round(v[1], 9) as x, round(v[2], 9) as y from pts")
def minmax_part(spark, sf_dir):
    return points(spark, sf_dir, "p2").select("id", F.round(F.col("v")[0], 9).alias("x"), F.round(F.col("v")[1], 9).alias("y"))


def _pairs(name, eps, route="auto"):
    def run(spark, sf_dir):
        got = pairs.pairs(points(spark, sf_dir, name), eps, route)
        return got.select("i", "j", F.round("d2", 6).alias("d2"), "code")

    return run


for _name, _points, _eps, _route in (
    ("eps_pairs_e64", "e64", [1.18], "auto"),
    ("eps_pairs_c1", "c1", [5.005], "auto"),
    ("eps_codes_e64", "e64", EPS, "auto"),
    ("eps_codes_e64_blocks", "e64", EPS, "blocks"),
    ("eps_codes_e64_expressions", "e64", EPS, "expressions"),
    ("eps_codes_e2_grid", "e2", [0.02, 0.035], "grid"),
    ("eps_codes_p2_grid", "p2", [0.0117, 0.023], "grid"),
):
    QUERIES[_name] = _pairs(_points, _eps, _route)
    ORACLE_SQL[_name] = sql.pairs(_points, _eps) + " select i, j, round(d2, 6) as d2, code from prs"


@query(sql.pairs("e64", EPS) + " select i, j from prs where code <= 1")
def filter_radius_e64(spark, sf_dir):
    return pairs.within(pairs.pairs(points(spark, sf_dir, "e64"), EPS), 1).select("i", "j")


_DEG = sql.pairs("e64", EPS) + """, deg as (select e as eps_idx, id, 1 + count(a) as degree from (values (0), (1), (2)) t(e) cross join pts
  left join (select i as a, code from prs union all select j, code from prs) on a = id and code <= e group by all)"""


@query(_DEG + " select id, degree, coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as row_offset from deg where eps_idx = 2")
def csr_degree_e64(spark, sf_dir):
    p = points(spark, sf_dir, "e64")
    return degrees.offsets(degrees.degrees(p, pairs.pairs(p, EPS), 3), 2)


@query(_DEG + " select eps_idx, count(*) as n, sum(degree)::bigint as nnz, max(degree) as max_degree, round(sum(degree) / (count(*)::double * count(*)), 9) as density, round(sum(degree) / count(*)::double, 9) as mean_degree from deg group by eps_idx")
def nnz_density_e64(spark, sf_dir):
    p = points(spark, sf_dir, "e64")
    got = degrees.totals(degrees.degrees(p, pairs.pairs(p, EPS), 3))
    return got.withColumns({c: F.round(c, 9) for c in ("density", "mean_degree")})


@query(_DEG + " select eps_idx * 3 + m as config, id, degree >= p as is_core from deg, (values (0, 3), (1, 4), (2, 8)) t(m, p)")
def core_masks_e64(spark, sf_dir):
    p = points(spark, sf_dir, "e64")
    return degrees.core_masks(degrees.degrees(p, pairs.pairs(p, EPS), 3), MIN_PTS)


# grids


@query("select k::int as k, round(0.1 + k * 0.2, 9)::double as eps from range(0, 3) t(k)")
def eps_range(spark, sf_dir):
    return spark.createDataFrame([(k, round(e, 9)) for k, e in enumerate(grid.expand_range(0.1, 0.55, 0.2))], "k int, eps double")


@query("select (row_number() over (order by p_size) - 1)::int as k, p_size::double as v from (select distinct p_size from part)")
def normalize_grid(spark, sf_dir):
    sizes = [r.v for r in _table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("v")).distinct().collect()]  # 50 sizes
    return spark.createDataFrame(list(enumerate(grid.normalize(sizes + sizes))), "k int, v double")


@query("select * from (values (0, 8), (1, 11), (2, 15), (3, 20), (4, 27), (5, 37), (6, 50), (7, 68)) t(k, min_pts)")
def minpts_pool(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(grid.min_pts_pool([8, 17, 34, 68], 8))), "k int, min_pts int")


@query("select e * 3 + m as config, e as eps_idx, eps, m as mp_idx, p as min_pts from (values (0, 1.1::double), (1, 1.14), (2, 1.18)) a(e, eps), (values (0, 3), (1, 4), (2, 8)) b(m, p)")
def grid_configurations(spark, sf_dir):
    return grid.configurations(spark, EPS, MIN_PTS)


@query("with c as (select 'c' || (event_id % 20) as id, count(distinct event_type) as r, 1 + max(event_id % 3) as e, 2 as m from events group by 1) select count(*) as cases, sum(r + 2)::bigint as variants, (10 * sum(r + 2))::bigint as records, (10 * sum(r + 2 * e * m))::bigint as measured_fits, (10 * sum(r + 2 * e * m))::bigint as warmup_fits, (20 * sum(r + 2 * e * m))::bigint as total_fits from c")
def plan_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy((F.col("event_id") % 20).alias("c")).agg(F.collect_set("event_type").alias("routes"), (1 + F.max(F.col("event_id") % 3)).alias("e")).collect()
    cases = [{"id": r.c, "routes": r.routes, "eps_indices": list(range(r.e)), "minpts_indices": [0, 1]} for r in rows]
    return spark.createDataFrame([grid.plan_counts(cases, 10, 1)], "cases bigint, variants bigint, records bigint, measured_fits bigint, warmup_fits bigint, total_fits bigint")


# clustering


def _labels(name, eps, min_pts, local_links=forest.LOCAL_LINKS, route="auto"):
    return lambda spark, sf_dir: dbscan.fit(points(spark, sf_dir, name), eps, min_pts, route, local_links).labels()


_LAB = " select config, id, label, is_core from lab"
for _name, _points, _eps, _counts, _more in (
    ("dbscan_scalar_e64", "e64", [1.18], [3], {}),
    ("dbscan_scalar_c1", "c1", [5.005], [3], {}),
    ("dbscan_scalar_p2", "p2", [0.023], [4], {"route": "grid"}),
    ("multi_eps_e64", "e64", EPS, [4], {}),
    ("multi_minpts_e64", "e64", [1.18], MIN_PTS, {}),
    ("multi_both_e64", "e64", EPS, MIN_PTS, {}),
    ("multi_both_e64_rounds", "e64", EPS, MIN_PTS, {"local_links": 0}),
    ("multi_both_e2", "e2", [0.03, 0.035], [4, 8], {}),
    ("multi_both_e4", "e4", [0.06, 0.08], [4, 8], {}),
    ("multi_both_p2", "p2", [0.015, 0.023], [4, 8], {}),
    ("multi_both_c1", "c1", [3.005, 5.005], [3, 5], {}),
):
    QUERIES[_name] = _labels(_points, _eps, _counts, **_more)
    ORACLE_SQL[_name] = sql.grid(_points, _eps, _counts) + _LAB

_GRID = sql.grid("e64", EPS, MIN_PTS)


def _fit(spark, sf_dir):
    return dbscan.fit(points(spark, sf_dir, "e64"), EPS, MIN_PTS)


@query(_GRID + _LAB)
def solo_grid_e64(spark, sf_dir):
    return dbscan.solo(points(spark, sf_dir, "e64"), EPS, MIN_PTS)


_SUMMARY = "select config, (max(label) + 1)::bigint as n_clusters, count(*) filter (label < 0) as n_noise, count(*) filter (is_core) as n_core from lab group by config"


@query(f"{_GRID}, s as ({_SUMMARY}), z as (select config, max(c) as largest from (select config, label, count(*) as c from lab where label >= 0 group by all) group by config) select s.*, coalesce(largest, 0) as largest from s left join z using (config)")
def config_summary(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"{_GRID}, s as ({_SUMMARY}), t as (select s.*, config // 3 as e, config % 3 as m from s) select 'min_pts' as axis, a.config, a.n_noise, b.n_noise as before from t a join t b on a.e = b.e and a.m = b.m + 1 where a.n_noise < b.n_noise union all select 'eps', a.config, a.n_noise, b.n_noise from t a join t b on a.m = b.m and a.e = b.e + 1 where a.n_noise > b.n_noise")
def monotonicity(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    return validate.monotonicity(dbscan.summary(fit.labels()), fit.configurations)


_STRUCT = _GRID + """, comp as (select config, root, dense_rank() over (partition by config order by root) - 1 as component from (select distinct config, root from root)),
adj as (select config, id, array_to_string(list_sort(list(distinct component)), ',') as adjacent, count(distinct component) as k from beside join comp using (config, root) group by all),
st as materialized (select d.config, d.id, d.degree, d.degree >= d.min_pts as is_core, c.component, coalesce(a.adjacent, '') as adjacent, coalesce(a.k, 0) as k
  from deg d left join root r on r.config = d.config and r.id = d.id left join comp c on c.config = r.config and c.root = r.root left join adj a on a.config = d.config and a.id = d.id)"""


@query(_STRUCT + " select config, id, degree, is_core, component, adjacent, k > 1 as ambiguous, not is_core and k = 0 as noise from st")
def adjacent_components(spark, sf_dir):
    return validate.structure(_fit(spark, sf_dir)).withColumn("adjacent", F.array_join("adjacent", ","))


@query(_STRUCT + " select config, count(*) filter (k > 1) as n_ambiguous, count(*) filter (not is_core and k > 0) as n_border from st group by config")
def ambiguous_borders(spark, sf_dir):
    st = validate.structure(_fit(spark, sf_dir))
    return st.groupBy("config").agg(F.count_if("ambiguous").alias("n_ambiguous"), F.count_if(~F.col("is_core") & (F.size("adjacent") > 0)).alias("n_border"))


def _scrambled(labels: DataFrame) -> DataFrame:
    return labels.select("config", "id", F.when(F.col("label") < 0, F.col("label")).otherwise(5000 - 3 * F.col("label")).cast("int").alias("label"))


@query(_GRID + " select config, id, label from lab")
def canonical_labels(spark, sf_dir):
    return canonical.canonical(_scrambled(_fit(spark, sf_dir).labels()))


def _mutated(labels: DataFrame) -> DataFrame:
    """Wrong on purpose: by id, some points to noise, some to cluster 0, some below -1, one label merged."""
    k = F.col("id") % 50
    return labels.select("config", "id", F.when(k == 7, -1).when(k == 11, 0).when(k == 13, -3).when((k == 17) & (F.col("label") == 1), 0).otherwise(F.col("label")).cast("int").alias("label"))


_MUTATED = _STRUCT + """, mut as materialized (select s.*, case when s.id % 50 = 7 then -1 when s.id % 50 = 11 then 0 when s.id % 50 = 13 then -3 when s.id % 50 = 17 and l.label = 1 then 0 else l.label end as label
  from st s join lab l on l.config = s.config and l.id = s.id),
owner as (select config, label, list(distinct component) as own, count(distinct component) as n, min(id) as id from mut where is_core and label >= 0 group by all),
bad as (
  select config, 'rotulo_negativo_invalido' as code, id from mut where label < -1
  union all select config, 'componente_core_fragmentado', id from (select config, component, min(id) as id, count(distinct label) as n, min(label) as l from mut where is_core group by all) where n > 1 or l < 0
  union all select config, 'componentes_core_fundidos', id from owner where n > 1
  union all select config, 'ruido_rotulado_como_cluster', id from mut where not is_core and k = 0 and label >= 0
  union all select config, 'borda_rotulada_como_ruido', id from mut where not is_core and k > 0 and label < 0
  union all select m.config, 'borda_em_componente_nao_adjacente', m.id from mut m left join owner o on o.config = m.config and o.label = m.label
    where not is_core and k > 0 and m.label >= 0 and (own is null or not list_has_any(list_transform(own, lambda x: x::varchar), string_split(adjacent, ','))))"""


@query(_MUTATED + " select config, code, id from (select *, row_number() over (partition by config, code order by id) as rn from bad) where rn <= 20")
def semantic_violations(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    return validate.violations(written(validate.structure(fit), "structure"), written(_mutated(fit.labels()), "labels"))


@query(_GRID + " select config, 'particao_identica_e_semanticamente_valida' as status, 1.0::double as ari, count(*) - count(*) as n_moved from lab group by config")
def semantic_comparison(spark, sf_dir):
    """The labels of a fit against the same partitions under other names."""
    fit = _fit(spark, sf_dir)
    own = written(fit.labels().select("config", "id", "label"), "labels")
    return validate.semantic(written(validate.structure(fit), "structure"), own, _scrambled(own)).select("config", "status", F.round("ari", 9).alias("ari"), F.col("n_moved").cast("bigint").alias("n_moved"))


def _ari_sql(source: str) -> str:
    """For source(config, a, b)."""
    return f""", cells as (select config, a, b, count(*)::double as n from {source} group by all),
ra as (select config, sum(n * (n - 1) / 2) as sa, sum(n) as n from (select config, a, sum(n) as n from cells group by all) group by config),
rb as (select config, sum(n * (n - 1) / 2) as sb from (select config, b, sum(n) as n from cells group by all) group by config),
ix as (select config, sum(n * (n - 1) / 2) as idx from cells group by config),
ari as (select config, round(case when (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) then 1.0 else (idx - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) end, 9) as ari from ix join ra using (config) join rb using (config))"""


@query(_GRID + ", x as (select config, l.id, l.label as a, e.label::int as b from lab l join embeddings e on e.vec_id = l.id)" + _ari_sql("x") + " select * from ari")
def ari_vs_truth(spark, sf_dir):
    truth = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("b"))
    both = _fit(spark, sf_dir).labels().select("config", "id", F.col("label").alias("a")).join(truth, "id")
    return canonical.ari(both).select("config", F.round("ari", 9).alias("ari"))


@query(_GRID + """, x as (select a.config - 1 as config, a.id, b.label as a, a.label as b from lab a join lab b on b.config = a.config - 1 and b.id = a.id where a.config % 3 > 0)""" + _ari_sql("x") + """,
m as (select config, round(avg(((a < 0) = (b < 0))::int::double), 9) as noise_agreement, not bool_or(a != b) as identical, min(id) filter (a != b) as first_diff,
  (max(a) + 1)::bigint as n_clusters_a, (max(b) + 1)::bigint as n_clusters_b, count(*) filter (a < 0) as n_noise_a, count(*) filter (b < 0) as n_noise_b from x group by config)
select m.*, ari from m join ari using (config)""")
def partition_metrics(spark, sf_dir):
    """Each configuration against the next count of the same radius."""
    own = written(_fit(spark, sf_dir).labels().select("config", "id", "label"), "labels")
    later = own.where("config % 3 > 0").withColumn("config", F.col("config") - 1)
    got = canonical.compare(own, later)
    return got.withColumns({c: F.round(c, 9) for c in ("ari", "noise_agreement")})


@query(_GRID + """, s as (select config, count(*) as n from lab group by config)
select p.a as source_a, p.b as source_b, config, 1.0::double as ari, true as identical from s, (values ('alone', 'grid'), ('alone', 'scrambled'), ('grid', 'scrambled')) p(a, b)""")
def source_pairs(spark, sf_dir):
    own = written(_fit(spark, sf_dir).labels().select("config", "id", "label"), "labels")
    alone = dbscan.solo(points(spark, sf_dir, "e64"), EPS, MIN_PTS).select("config", "id", "label")
    named = [("grid", own), ("alone", alone), ("scrambled", _scrambled(own))]
    rows = None
    for name, labels in named:
        part = labels.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return canonical.source_pairs(written(rows, "labels")).select("source_a", "source_b", "config", F.round("ari", 9).alias("ari"), "identical")


@query(_GRID + " select 1 as run, min(config) as first_config, min(id) filter (config = 0) as first_id, count(*) as n_diff from lab where label >= 0 and label != 5000 - 3 * label group by 1")
def determinism(spark, sf_dir):
    """Run 1 has its labels renamed, so it differs where there are clusters; run 2 repeats the first and differs nowhere."""
    own = written(_fit(spark, sf_dir).labels().select("config", "id", "label"), "labels")
    runs = own.withColumn("run", F.lit(0)).unionByName(_scrambled(own).withColumn("run", F.lit(1))).unionByName(_fit(spark, sf_dir).labels().select("config", "id", "label").withColumn("run", F.lit(2)))
    return canonical.determinism(runs)


# neighbours and suggestion

_KNN = f"""with pts as materialized ({sql.POINTS['e64'][0]}),
nn as materialized (select a.id, b.id as neighbour, sqrt({sql.distance(64)}) as dist, row_number() over (partition by a.id order by a.id != b.id, {sql.distance(64)}, b.id) - 1 as rank from pts a, pts b)"""


@query(_KNN + " select id, rank::int as rank, neighbour, round(dist, 6) as dist from nn where rank < 11")
def knn_topk_e64(spark, sf_dir):
    return pairs.knn(points(spark, sf_dir, "e64"), 11).withColumn("dist", F.round("dist", 6))


@query(_KNN + " select round(quantile_cont(dist, 0.5), 6) as q50, round(quantile_cont(dist, 0.7), 6) as q70, round(quantile_cont(dist, 0.85), 6) as q85 from nn where rank = 3")
def kdist_quantiles(spark, sf_dir):
    dist = pairs.knn(points(spark, sf_dir, "e64"), 4).where("rank = 3")
    return dist.agg(*(F.round(F.percentile("dist", F.lit(q)), 6).alias(n) for n, q in (("q50", 0.5), ("q70", 0.7), ("q85", 0.85))))


_DIM = _KNN + """, rk as (select id, dist as r from nn where rank = 20),
m as (select id, avg(ln((r + 1e-12) / (dist + 1e-12))) as m from nn join rk using (id) where rank between 1 and 19 group by id),
dim as (select least(greatest(quantile_cont(1 / greatest(m, 1e-12), 0.5), 1), 128) as dim from m)"""


@query(_DIM + " select round(dim, 6) as dim from dim")
def intrinsic_dim(spark, sf_dir):
    return suggest.intrinsic_dimension(points(spark, sf_dir, "e64")).select(F.round("dim", 6).alias("dim"))


@query(_DIM + ", base as (select greatest(4, ceil(2 * dim), ceil(log2((select count(*) from pts)))) as b from dim) select distinct least(256, greatest(4, x))::int as min_pts from (select unnest([floor(b / 2), b, 2 * b, 4 * b]) as x from base)")
def suggest_minpts(spark, sf_dir):
    p = points(spark, sf_dir, "e64")
    counts = suggest.min_pts(p.count(), suggest.intrinsic_dimension(p).first().dim)
    return spark.createDataFrame([(c,) for c in counts], "min_pts int")


@query(_KNN + " select distinct round(greatest(q, 1e-6)::float::double, 6) as eps from (select unnest(quantile_cont(dist, [0.5, 0.7, 0.85])) as q from nn where rank = 7)")
def suggest_eps(spark, sf_dir):
    return suggest.eps(points(spark, sf_dir, "e64"), 8).select(F.explode("eps").alias("eps")).select(F.round("eps", 6).alias("eps"))


# statistics


@query("select l_returnflag as flag, count(l_quantity) as n, median(l_extendedprice) as median, round(avg(l_extendedprice), 4) as mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) as stddev, min(l_extendedprice) as min, max(l_extendedprice) as max, round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(quantile_cont(l_extendedprice, 0.75), 4) as p75, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr from lineitem group by 1")
def descriptive_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    got = stats.descriptive(rows, ["flag"], "l_extendedprice")
    return got.withColumns({c: F.round(c, 4) for c in ("mean", "stddev", "p25", "p75", "iqr")})


_WIDE = sql.RECORDS + """, wide as (select case_id, block, max(fit_ms) filter (method = 'multi') as multi, max(fit_ms) filter (method = 'sequential') as sequential, max(fit_ms) filter (method = 'baseline') as baseline from rec group by all)"""


@query(_WIDE + " select case_id, block, round(multi, 6) as multi, round(sequential, 6) as sequential, round(baseline, 6) as baseline, round(sequential / multi, 6) as gain, round(baseline / multi, 6) as speedup from wide")
def block_pivot_ratios(spark, sf_dir):
    got = stats.block_ratios(records(spark, sf_dir))
    return got.withColumns({c: F.round(c, 6) for c in ("multi", "sequential", "baseline", "gain", "speedup")})


@query(_WIDE + " select case_id, (block // 2)::bigint as pair, round(exp(avg(ln(sequential / multi))), 6) as ratio from wide group by all having count(*) = 2 and min(sequential / multi) > 0")
def paired_ratio_geomean(spark, sf_dir):
    got = stats.block_ratios(records(spark, sf_dir)).select("case_id", F.floor(F.col("block") / 2).alias("pair"), F.col("gain").alias("ratio"))
    return stats.paired_ratios(got.where("ratio is not null"), ["case_id", "pair"]).withColumn("ratio", F.round("ratio", 6))


@query(sql.RECORDS + """, bad as (select distinct case_id from rec where fit_ms > (select quantile_cont(fit_ms, 0.99) from rec))
select case_id, block, method from rec where case_id not in (select case_id from bad) and case_id not in ('c3', 'c4')""")
def completeness_antijoin(spark, sf_dir):
    """Case 3 lacks an expected block, case 4 has one too many, and the slowest hundredth counts as failed."""
    rec = written(records(spark, sf_dir), "records")
    limit = rec.agg(F.percentile("fit_ms", F.lit(0.99)).alias("limit"))
    judged = rec.crossJoin(F.broadcast(limit)).withColumn("ok", F.col("fit_ms") <= F.col("limit"))
    axes = ["case_id", "block", "method"]
    expected = rec.select(*axes).where("not (case_id = 'c4' and block = 5)").unionByName(rec.where("case_id = 'c3'").select("case_id", F.lit(6).alias("block"), "method").distinct())
    return stats.complete(judged, expected, axes).select(*axes)


@query("select user_id, event_type, count(*) as n from events group by all having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return stats.duplicates(_table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("select l_returnflag as flag, round(regr_slope(l_extendedprice, l_quantity), 4) as marginal, round(regr_intercept(l_extendedprice, l_quantity), 3) as fixed, round((regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity)) / regr_slope(l_extendedprice, l_quantity), 4) as ceiling from lineitem group by 1")
def ols_cost_model(spark, sf_dir):
    got = stats.cost_fit(_table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity", "l_extendedprice")
    return got.select("flag", F.round("marginal", 4).alias("marginal"), F.round("fixed", 3).alias("fixed"), F.round("ceiling", 4).alias("ceiling"))


@query("with r as (select c_mktsegment as segment, c_acctbal + 2000 as x, c_custkey as k from customer) select segment, round((sum(x) - arg_min(x, k)) / (count(*) - 1) / arg_min(x, k), 6) as degradation from r group by 1")
def degradation(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") + 2000).alias("x"), "c_custkey")
    return stats.degradation(rows, ["segment"], "c_custkey", "x").withColumn("degradation", F.round("degradation", 6))


@query("with p as (select event_type = (select min(event_type) from events) as own, abs(value) as ms from events) select round(sum(ms) filter (not own), 3) as shared, round(sum(ms) filter (own), 3) as per_config, round(sum(ms), 3) as total, round(sum(ms) filter (not own) / sum(ms), 6) as share_shared, round(sum(ms) / sum(ms) filter (own), 6) as ceiling from p")
def profile_rollup(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("t"))
    got = stats.profile(e.crossJoin(F.broadcast(first)).select((F.col("event_type") == F.col("t")).alias("per_config"), F.abs("value").alias("ms")))
    return got.select(*(F.round(c, 3).alias(c) for c in ("shared", "per_config", "total")), *(F.round(c, 6).alias(c) for c in ("share_shared", "ceiling")))


@query("select l_returnflag as flag, round((max(l_extendedprice) - min(l_quantity)) / (count(*) - 1), 6) as marginal from lineitem group by 1")
def marginal_cost(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("grid_ms"), F.col("l_quantity").alias("solo_ms"))
    return stats.marginal_cost(rows, ["flag"]).withColumn("marginal", F.round("marginal", 6))


@query()
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap(stats.block_ratios(records(spark, sf_dir)), ["case_id"], "gain", "block")


@query()
def synthetic_families(spark, sf_dir):
    """Every family once: points, true labels and noise."""
    out = None
    for f in synthetic.FAMILIES:
        part = synthetic.generate(spark, f, 400, 4).select(F.lit(f).alias("family"), "truth", F.size("v").alias("d"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("family").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.count_distinct("truth").alias("n_truth"), F.count_if(F.col("truth") < 0).alias("n_noise"))
