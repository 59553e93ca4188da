"""Exact density clustering of a whole grid of radii and counts in one plan.

One pair table at the largest radius, one aggregation for all degrees, one spanning forest for each count. Labels are
deterministic: core points of a component share its smallest core id as root; a border point takes the smallest root
among its core neighbours; labels number the clusters of a configuration by their smallest member, and noise is -1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import grid, vectors
from lattica.operators import degrees, forest, pairs
from lattica.sources.ranges import ranked
from lattica.sources.stored import written

#: Clusters of all configurations that one task may number for each configuration.
LOCAL_CLUSTERS = 4_000_000
#: Places for each point up to which copies are searched once.
FEW_PLACES = 0.9
#: Points not core at the first radius, up to which they are broadcast to their pairs.
FEW_LATE = 100_000


@dataclass
class Grid:
    """The parts of a fit: pairs, degrees, core flags and roots are tables, labels are computed when asked for."""

    points: DataFrame
    eps: list[float]
    min_pts: list[int]
    table: DataFrame
    deg: DataFrame
    core: DataFrame
    roots: DataFrame
    #: The fit of one point for each place, and (id, kind): every point and the smallest id at its place; where copies abound.
    kinds: Grid | None = None
    copies: DataFrame | None = None

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Rows of the kinds' fit for every copy."""
        return spread(rows, self.copies)

    @property
    def configurations(self) -> DataFrame:
        return grid.configurations(self.points.sparkSession, self.eps, self.min_pts)

    def config(self):
        return F.col("eps_idx") * len(self.min_pts) + F.col("mp_idx")

    def _beside(self) -> DataFrame:
        """(mp_idx, eps_idx, id, root) of points that are not core and their core neighbours' roots.

        Only pairs are followed where one end is core while the other isn't yet: from the pair's radius and the core's
        own (`w`) up to the radius before the point becomes core itself. They are reduced to one row for each point and
        root at `w` before radii are told apart, as a neighbour's root at a later radius is that of its root at `w`.
        """
        if self.kinds:
            return self._spread(self.kinds._beside())
        first = self.deg.select("id", F.array(*(F.expr(f"size(filter(deg, x -> x < {p}))") for p in self.min_pts)).alias("own"))
        both = self.table.select(F.col("i").alias("id"), F.col("j").alias("other"), "code").union(self.table.select("j", "i", "code"))
        some = first.where(F.array_max("own") > 0)
        late = both.join(F.broadcast(some) if some.count() <= FEW_LATE else some, "id").where(F.col("code") < F.array_max("own"))
        late = late.join(first.select(F.col("id").alias("other"), F.col("own").alias("theirs")), "other")
        spans = F.transform(F.sequence(F.lit(0), F.lit(len(self.min_pts) - 1)), lambda m: F.struct(m.alias("mp_idx"), F.get("own", m).alias("until"), F.greatest("code", F.get("theirs", m)).alias("w")))
        near = late.select("id", "other", F.explode(F.filter(spans, lambda s: s["w"] < s["until"])).alias("s")).select("id", "other", "s.*")
        at = self.roots.select("mp_idx", F.col("eps_idx").alias("w"), F.col("id").alias("other"), "root")
        near = near.join(at, ["mp_idx", "w", "other"]).select("mp_idx", "id", "w", "until", "root").distinct()
        if len(self.eps) == 1:
            return near.select("mp_idx", F.col("w").alias("eps_idx"), "id", "root")
        each = near.select("mp_idx", F.explode(F.sequence("w", F.col("until") - 1)).alias("eps_idx"), "id", F.col("root").alias("r"))
        return each.join(self.roots.select("mp_idx", "eps_idx", F.col("id").alias("r"), "root"), ["mp_idx", "eps_idx", "r"]).select("mp_idx", "eps_idx", "id", "root")

    def adjacent(self) -> DataFrame:
        """(config, id, roots): for points that are not core, the roots of their core neighbours, ascending."""
        return self._beside().groupBy(self.config().alias("config"), "id").agg(F.array_sort(F.collect_set("root")).alias("roots"))

    def members(self) -> DataFrame:
        """(config, id, root, is_core) of all points that are in a cluster."""
        if self.kinds:
            return self._spread(self.kinds.members())
        border = self._beside().groupBy("mp_idx", "eps_idx", "id").agg(F.min("root").alias("root"))
        core = self.roots.select("mp_idx", "eps_idx", "id", "root", F.lit(True).alias("is_core"))
        return core.unionByName(border.withColumn("is_core", F.lit(False))).select(self.config().alias("config"), "id", "root", "is_core")

    def labels(self) -> DataFrame:
        """(config, id, label, is_core) of every point in every configuration."""
        if self.kinds:
            return self._spread(self.kinds.labels())
        members = written(self.members(), "members")
        first = members.groupBy("config", "root").agg(F.min("id").alias("first"))
        if self.roots.where("id = root").count() > LOCAL_CLUSTERS:
            named = ranked(first, ["config"], ["first"], "nth").select("config", "root", (F.col("nth") - 1).cast("int").alias("label"))
        else:
            named = first.select("config", "root", (F.dense_rank().over(Window.partitionBy("config").orderBy("first")) - 1).alias("label"))
        known = members.join(named, ["config", "root"]).select("config", "id", "label", "is_core")
        configs = self.points.sparkSession.range(len(self.eps) * len(self.min_pts)).select(F.col("id").cast("int").alias("config"))
        every = self.points.select("id").crossJoin(F.broadcast(configs))  # at most a few hundred configurations
        return every.join(known, ["config", "id"], "left").select("config", "id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def fit(points: DataFrame, eps: list[float], min_pts: list[int], route: str = "auto", local_links: int = forest.LOCAL_LINKS, max_pairs: int = pairs.MAX_PAIRS) -> Grid:
    """points: (id BIGINT, v ARRAY<DOUBLE>), checked; eps and min_pts are sorted and made distinct.

    Where at most FEW_PLACES of the points have a place of their own, one point for each place is searched, and counts as
    many times as it has copies: these share its degrees, its root and its label.
    A radius whose pairs are estimated above max_pairs raises `pairs.TooManyPairs` before any pair is made.
    """
    eps, min_pts = grid.radii(eps), grid.densities(min_pts)
    points = points.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    n, d = vectors.check(points)
    if points.agg(F.count_distinct(F.xxhash64("v"))).first()[0] > FEW_PLACES * n:
        return _fit(points, None, (n, d), eps, min_pts, route, local_links, max_pairs)
    places = written(points.groupBy("v").agg(F.min("id").alias("kind"), F.count("*").alias("weight")), "places")
    copies = written(points.join(places, "v").select("id", "kind"), "copies")
    kinds = _fit(places.select(F.col("kind").alias("id"), "v"), places.select(F.col("kind").alias("id"), "weight"), (places.count(), d), eps, min_pts, route, local_links, max_pairs)
    return Grid(points, eps, min_pts, kinds.table, *(spread(x, copies) for x in (kinds.deg, kinds.core, kinds.roots)), kinds, copies)


def spread(rows: DataFrame, copies: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("id", "kind").join(copies, "kind").select(*rows.columns)


def _fit(points: DataFrame, weights: DataFrame | None, size: tuple[int, int], eps: list[float], min_pts: list[int], route: str, local_links: int, max_pairs: int) -> Grid:
    table = written(pairs.pairs(points, eps, route, size, max_pairs), "pairs")
    deg = written(degrees.degrees(points, table, len(eps), weights), "degrees")
    core = degrees.core_radius(deg, min_pts)  # a narrow step from a stored table
    if forest.shareable(size[0], len(min_pts), len(eps)):
        links = forest.shared(table, core, len(eps))
    else:
        links = forest.spanning(forest.core_links(table, core))
    roots = written(forest.components(core, links, len(eps), local_links), "roots")
    return Grid(points, eps, min_pts, table, deg, core, roots)


def dbscan_grid(points: DataFrame, eps: list[float], min_pts: list[int], route: str = "auto") -> DataFrame:
    """(config, eps, min_pts, id, label, is_core)."""
    got = fit(points, eps, min_pts, route)
    return got.labels().join(F.broadcast(got.configurations), "config").select("config", "eps", "min_pts", "id", "label", "is_core")


def dbscan(points: DataFrame, eps: float, min_pts: int, route: str = "auto") -> DataFrame:
    """(id, label, is_core) of one configuration."""
    return fit(points, [eps], [min_pts], route).labels().drop("config")


def solo(points: DataFrame, eps: list[float], min_pts: list[int]) -> DataFrame:
    """The grid, every configuration fitted alone: what one plan for all is measured against."""
    eps, min_pts = grid.radii(eps), grid.densities(min_pts)
    parts = [dbscan(points, e, m).withColumn("config", F.lit(k * len(min_pts) + q)) for k, e in enumerate(eps) for q, m in enumerate(min_pts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("config", "id", "label", "is_core")


def summary(labels: DataFrame) -> DataFrame:
    """(config, n_clusters, n_noise, n_core, largest)."""
    sizes = labels.groupBy("config", "label").agg(F.count("*").alias("c"), F.count_if("is_core").alias("k"))
    return sizes.groupBy("config").agg((F.max("label") + 1).cast("bigint").alias("n_clusters"), F.sum(F.when(F.col("label") < 0, F.col("c")).otherwise(0)).alias("n_noise"), F.sum("k").alias("n_core"), F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("c"))), F.lit(0)).alias("largest"))
