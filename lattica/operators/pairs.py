"""The neighbour pair table: every pair within the largest radius once, with the smallest radius that holds it.

A grid of radii needs one search, at the largest; `code` says which radii hold a pair. Pairs are stored once (i < j);
the pair of a point with itself is implied, so degrees start at 1.

Routes, which give the same rows:
- broadcast: blocks of points against the whole matrix, for at most BROADCAST_BYTES of it (checked).
- blocks: points dealt to blocks along their widest coordinate, a task for each pair of blocks that the radius can
  bridge there, so no task holds more than two blocks and far blocks never meet.
- grid: cells of the largest radius over the first coordinates; only neighbouring cells meet, in an equi-join that
  adaptive execution can split where cells are crowded. Exact at any width, worthwhile where few coordinates separate.
- expressions: a nested loop of column expressions; the independent check of the others.

All pairs within a radius may be far more than can be stored. Where that is possible at all, their number is estimated
first, from the neighbours of a few hundred points, and a search over its budget is refused (`TooManyPairs`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vectors
from lattica.sources.stored import written

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS, BLOCK_BYTES = 4096, 64 << 20
#: Pairs that a search may store (some 28 bytes each), and the points whose neighbours estimate them.
MAX_PAIRS = 20_000_000_000
ASKED = 512
#: Coordinates among which the widest is looked for.
AXES = 64
#: Rows and columns whose products are made at once.
TILE, COLUMNS = 512, 8192
#: Coordinates that the nested loop takes as columns.
UNROLLED = 128
SCHEMA = "i bigint, j bigint, d2 double, code int"


def _matrix(batch) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    n = len(v)
    return np.asarray(batch.column("id")), np.asarray(v.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def sides(x: np.ndarray, y: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray, float]:
    """left, right and room, so that left @ right.T are all squared distances up to room, which bounds rounding at that width."""
    centre = y.mean(0) if len(y) else 0.0
    x, y = x - centre, y - centre
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[:, None]
    scale, d = float(max(xx.max(initial=0), yy.max(initial=0))), x.shape[1]
    with np.errstate(over="ignore"):
        left, right = (np.concatenate(c, 1).astype(dtype) for c in ((-2 * x, xx, np.ones_like(xx)), (y, np.ones_like(yy), yy)))
    info = np.finfo(dtype)
    room = 8 * (d + 4) * (float(info.eps) * scale + float(info.tiny))
    return left, right, room if scale < float(info.max) / 16 else math.inf


def distances(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, coordinate by coordinate."""
    d2, step = np.zeros(len(a)), max(64, (1 << 17) // max(1, a.shape[1]))
    for lo in range(0, len(a), step):
        diff = a[lo : lo + step] - y[lo : lo + step]
        diff *= diff
        for c in range(diff.shape[1]):
            d2[lo : lo + step] += diff[:, c]
    return d2


def ordered(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points by ascending id; the same arrays where they are so already."""
    if (ids[1:] >= ids[:-1]).all():
        return ids, x
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def near(ids: np.ndarray, x: np.ndarray, jds: np.ndarray, y: np.ndarray, eps: list[float]) -> Iterator[pa.RecordBatch]:
    """Pairs i < j of two blocks. Products find candidates with room for rounding; differences then decide.

    Single precision is enough for that where its rounding is small beside the radius. Both blocks are taken in the order of
    their ids, so that half of the products are left out where the blocks have the same points. Factors are made for COLUMNS
    points of y at a time: nothing is as large as y but y itself, if that comes in order.
    """
    squares = np.array([e * e for e in eps])
    (ids, x), (jds, y) = ordered(ids, x), ordered(jds, y)
    for at in range(0, len(y), COLUMNS):
        jd, z = jds[at : at + COLUMNS], y[at : at + COLUMNS]
        n = int(np.searchsorted(ids, jd[-1], "left"))  # later points have no partner here
        if not n:
            continue
        left, right, room = sides(x[:n], z, np.float32)
        if not room <= 1e-3 * squares[-1]:
            left, right, room = sides(x[:n], z, np.float64)
        room = squares[-1] * (1 + 1e-9) + 2 * room
        for lo in range(0, n, TILE):
            first = int(np.searchsorted(jd, ids[lo], "right"))
            p, q = np.nonzero(left[lo : lo + TILE] @ right[first:].T <= room)
            for k in range(0, len(p), 1 << 16):
                pp, qq = lo + p[k : k + (1 << 16)], first + q[k : k + (1 << 16)]
                own = ids[pp] < jd[qq]
                pp, qq = pp[own], qq[own]
                d2 = distances(x[pp], z[qq])
                code = np.searchsorted(squares, d2)
                ok = code < len(eps)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[pp[ok]]), pa.array(jd[qq[ok]]), pa.array(d2[ok]), pa.array(code[ok].astype(np.int32))], names=["i", "j", "d2", "code"])


def by_broadcast(points: DataFrame, eps: list[float]) -> DataFrame:
    """For a matrix whose size has been checked."""
    table = points.select("id", "v").toArrow()
    shared = points.sparkSession.sparkContext.broadcast(ordered(*_matrix(table)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jds, y = shared.value
        for batch in batches:
            ids, x = _matrix(batch)
            if len(x):
                yield from near(ids, x, jds, y, eps)

    parts = points.sparkSession.sparkContext.defaultParallelism
    return points.select("id", "v").repartition(parts).mapInArrow(search, SCHEMA)


def widest(points: DataFrame, d: int) -> int:
    """The coordinate of the largest variance among the first AXES."""
    k = min(d, AXES)
    spread = points.agg(*(F.var_pop(F.col("v")[c]).alias(f"s{c}") for c in range(k))).first()
    return max(range(k), key=lambda c: (spread[c] or 0.0, -c))


def blocks(points: DataFrame, reach: float, n: int, d: int, block_rows: int) -> DataFrame:
    """(id, v, b, first, last): a point's block and the blocks it has to meet, which follow one another.

    Blocks are ranges of the widest coordinate of about block_rows points; a range with more of them, as with ties, is
    split by a hash. Blocks whose ranges lie further apart than the radius hold no pair.
    """
    t = F.col("v")[widest(points, d)]
    g = max(1, math.ceil(n / block_rows))
    rows = written(points.select("id", "v", t.alias("t")).repartitionByRange(g, "t").withColumn("r", F.spark_partition_id()), "blocks")
    found = sorted(tuple(x) for x in rows.groupBy("r").agg(F.min("t"), F.max("t"), F.count("*")).collect())  # n / block_rows rows
    r, lo, hi, size = (np.array(c) for c in zip(*found, strict=True)) if found else ([], np.empty(0), np.empty(0), np.empty(0, int))
    splits = -(-size // block_rows)
    base = np.concatenate(([0], np.cumsum(splits))).astype(int)
    room = reach * (1 + 1e-9) + 1e-12 * max([1.0, *np.abs(lo), *np.abs(hi)])
    first = base[np.searchsorted(hi, lo - room, "left")] if found else []
    last = base[np.searchsorted(lo, hi + room, "right")] - 1 if found else []
    told = [tuple(int(x) for x in y) for y in zip(r, base, splits, first, last, strict=False)]
    about = points.sparkSession.createDataFrame(told, "r int, base int, splits int, first int, last int")
    own = (F.col("base") + F.pmod(F.xxhash64("id"), F.col("splits"))).cast("int")
    return rows.join(F.broadcast(about), "r").select("id", "v", own.alias("b"), "first", "last")


def by_blocks(points: DataFrame, eps: list[float], n: int, d: int, block_rows: int | None = None) -> DataFrame:
    rows = blocks(points, eps[-1], n, d, block_rows or max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(d, 1)))))
    dealt = rows.select("id", "v", "b", F.explode(F.sequence("first", "last")).alias("o"))
    dealt = dealt.select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "v")

    def search(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        b, (p, q) = np.asarray(table["b"]), (keys[0].as_py(), keys[1].as_py())
        found = []
        if p == q:
            found += near(ids, x, ids, x, eps)
        else:
            left, right = b == p, b == q
            found += near(ids[left], x[left], ids[right], x[right], eps)
            found += [pa.RecordBatch.from_arrays(r.columns, names=r.schema.names) for r in near(ids[right], x[right], ids[left], x[left], eps)]
        kind = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d2", pa.float64()), ("code", pa.int32())])
        return pa.Table.from_batches(found, kind)

    return dealt.groupBy("p", "q").applyInArrow(search, SCHEMA)


class TooManyPairs(ValueError):
    """A search was refused, as it would store more pairs than its budget."""


def estimate(points: DataFrame, radius: float, n: int, asked: int = ASKED) -> float:
    """About how many pairs i < j lie within the radius: the neighbours of about `asked` points, picked by a hash, for all."""
    share = min(1.0, asked / max(n, 1))
    some = points if share == 1.0 else points.where(F.pmod(F.xxhash64("id", F.lit("asked")), F.lit(1 << 30)) < int(share * (1 << 30)))
    ids, x = _matrix(some.select("id", "v").toArrow())
    if not len(x):
        return 0.0
    shared = points.sparkSession.sparkContext.broadcast(x)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, total = shared.value, 0
        for batch in batches:
            _, a = _matrix(batch)
            for lo in range(0, len(a), TILE):
                part = a[lo : lo + TILE]
                total += int(((part * part).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (part @ y.T) <= radius * radius).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["c"])

    near_them = points.select("id", "v").mapInArrow(count, "c bigint").agg(F.sum("c")).first()[0] or 0
    return max(0.0, near_them / len(x) - 1) * n / 2


def affordable(points: DataFrame, radius: float, n: int, max_pairs: int) -> None:
    """Raises if the pairs are estimated above the budget; asks only where there are points enough for that."""
    if n * (n - 1) // 2 > max_pairs and (found := estimate(points, radius, n)) > max_pairs:
        raise TooManyPairs(f"about {found:.3g} pairs of {n} points lie within {radius}, over the budget of {max_pairs}; take a smaller radius or raise max_pairs")


#: How much a tiled search gains over following links, and a search's fixed cost in operations (fixed values).
TILING, FIXED_COST = 40, 60_000_000_000


def one_search_pays(nnz: Column, searched: Column, n_eps: Column, d: Column, tiling: int = TILING, fixed: int = FIXED_COST) -> Column:
    """Whether telling radii apart on the links of one search costs less than a search for each further radius."""
    wide = lambda c: c.cast("double")
    return wide(nnz) * d * tiling < (wide(n_eps) - 1) * (wide(searched) * d + float(fixed))


def by_grid(points: DataFrame, eps: list[float], d: int, axes: int = 3) -> DataFrame:
    axes, side = min(axes, d), eps[-1]
    cell = [F.floor(F.col("v")[k] / side).cast("bigint") for k in range(axes)]
    home = points.select("id", "v", *(c.alias(f"c{k}") for k, c in enumerate(cell)))
    away = home
    for k in range(axes):
        away = away.withColumn(f"c{k}", F.explode(F.array(F.col(f"c{k}") - 1, F.col(f"c{k}"), F.col(f"c{k}") + 1)))
    a, b = home.alias("a"), away.alias("b")
    on = [F.col(f"a.c{k}") == F.col(f"b.c{k}") for k in range(axes)]
    met = a.join(b, on).where("a.id < b.id")
    d2 = vectors.unrolled_distance("a", "b", d) if d <= 16 else vectors.squared_distance(F.col("a.v"), F.col("b.v"))
    got = met.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), d2.alias("d2")).where(F.col("d2") <= side * side)
    return got.withColumn("code", vectors.code(F.col("d2"), eps))


def by_expressions(points: DataFrame, eps: list[float], d: int | None = None) -> DataFrame:
    """A nested loop; up to UNROLLED coordinates are columns of their own, so that a distance is made without lambdas."""
    d = vectors.check(points)[1] if d is None else d
    if d > UNROLLED:
        a, b = points.alias("a"), points.alias("b")
        d2 = vectors.squared_distance(F.col("a.v"), F.col("b.v"))
    else:
        flat = points.select("id", *(F.coalesce(F.col("v")[k], F.lit(0.0)).alias(f"v{k}") for k in range(d)))
        flat = flat.repartition(math.ceil(2 * math.sqrt(points.sparkSession.sparkContext.defaultParallelism)))
        a, b, d2 = flat.alias("a"), flat.alias("b"), F.lit(0.0)
        for k in range(d):
            x = F.col(f"a.v{k}") - F.col(f"b.v{k}")
            d2 = d2 + x * x
    met = a.hint("shuffle_replicate_nl").join(b, (F.col("a.id") < F.col("b.id")) & (d2 <= eps[-1] * eps[-1]))
    got = met.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), d2.alias("d2"))
    return got.withColumn("code", vectors.code(F.col("d2"), eps))


def plan(n: int, d: int) -> str:
    """grid where the first coordinates are all there is, broadcast where the matrix is small, else blocks."""
    if d <= 3 and n > 20_000:
        return "grid"
    return "broadcast" if n * max(d, 1) * 8 <= BROADCAST_BYTES else "blocks"


def pairs(points: DataFrame, eps: list[float], route: str = "auto", size: tuple[int, int] | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(i, j, d2, code) of all pairs within the largest of eps, which must be ascending."""
    n, d = size or vectors.check(points)
    affordable(points, eps[-1], n, max_pairs)
    route = plan(n, d) if route == "auto" else route
    if route == "broadcast":
        if n * max(d, 1) * 8 > BROADCAST_BYTES:
            raise ValueError("the matrix is too large to broadcast; use blocks or grid")
        return by_broadcast(points, eps)
    if route == "blocks":
        return by_blocks(points, eps, n, d)
    return by_grid(points, eps, d) if route == "grid" else by_expressions(points, eps, d)


def within(table: DataFrame, radius: int) -> DataFrame:
    """The pairs of the radius with that index."""
    return table.where(F.col("code") <= radius)


def knn(points: DataFrame, k: int, size: tuple[int, int] | None = None) -> DataFrame:
    """(id, rank, neighbour, dist): the k nearest of each point, itself included, ties by id; k is cut to n.

    Blocks of points meet blocks of the others and keep k each; the best k of these are kept per point, MERGED blocks at
    a time, so what a point gathers is at most k rows for each of so many.
    """
    n, d = size or vectors.check(points)
    k = min(k, n)
    if n * max(d, 1) * 8 > BROADCAST_BYTES:
        return _knn_blocks(points, k, n)
    shared = points.sparkSession.sparkContext.broadcast(_matrix(points.select("id", "v").toArrow()))

    def search(batches):
        jds, y = shared.value
        for batch in batches:
            ids, x = _matrix(batch)
            if len(x):
                yield nearest(ids, x, jds, y, k)

    parts = points.sparkSession.sparkContext.defaultParallelism
    return points.select("id", "v").repartition(parts).mapInArrow(search, "id bigint, rank int, neighbour bigint, dist double")


def nearest(ids: np.ndarray, x: np.ndarray, jds: np.ndarray, y: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest rows of y for each row of x: the point itself, then by distance and id.

    Products in single precision bound the k-th distance by the k-th least of the minima of groups of columns; what lies
    within that and the room for rounding is measured by differences. Where that room lets too much through, as far from
    the origin, the tile is done again in double precision.
    """
    order = np.argsort(jds, kind="stable")
    jds, y = jds[order], y[order]
    k = min(k, len(jds))
    made = {np.float32: sides(x, y, np.float32)}
    width = max(1, min(64, len(y) // (4 * k)))
    tile, out = max(1, min(TILE, (1 << 22) // len(y))), []
    for lo in range(0, len(x), tile):
        for dtype in (np.float32, np.float64):
            left, right, room = made[dtype] if dtype in made else made.setdefault(dtype, sides(x, y, dtype))
            if dtype is np.float32 and room == math.inf:
                continue
            rough = left[lo : lo + tile] @ right.T
            least = rough[:, : len(y) // width * width].reshape(len(rough), width, -1).min(1)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64)
            inside = rough <= (bound + 2 * room)[:, None].astype(dtype) * (1 + 4 * np.finfo(dtype).eps)
            if dtype is np.float64 or np.count_nonzero(inside) <= len(rough) * (16 * k + 256):
                break
        p, q = np.nonzero(inside)
        d2 = np.concatenate([distances(x[lo + p[c : c + (1 << 16)]], y[q[c : c + (1 << 16)]]) for c in range(0, len(p), 1 << 16)])
        order = np.lexsort((q, d2, jds[q] != ids[lo + p], p))
        p, q, d2 = p[order], q[order], d2[order]
        rank = np.arange(len(p)) - np.searchsorted(p, p, "left")
        kept = rank < k
        out.append((ids[lo + p[kept]], rank[kept].astype(np.int32), jds[q[kept]], np.sqrt(d2[kept])))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "rank", "neighbour", "dist"])


MERGED = 64


def _knn_blocks(points: DataFrame, k: int, n: int) -> DataFrame:
    g = max(1, math.ceil(n / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    rows = points.select("id", "v", block.alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    asked = rows.select("id", "v", F.col("b").alias("p"), every.alias("q"), F.lit(True).alias("asks"))
    held = rows.select("id", "v", every.alias("p"), F.col("b").alias("q"), F.lit(False).alias("asks"))

    def search(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        asks = np.asarray(table["asks"])
        if not asks.any() or asks.all():
            return pa.Table.from_batches([], pa.schema([("q", pa.int32()), ("id", pa.int64()), ("rank", pa.int32()), ("neighbour", pa.int64()), ("dist", pa.float64())]))
        got = nearest(ids[asks], x[asks], ids[~asks], x[~asks], k)
        return pa.Table.from_batches([got]).add_column(0, "q", pa.array(np.full(got.num_rows, keys[1].as_py(), np.int32)))

    some = asked.unionByName(held).groupBy("p", "q").applyInArrow(search, "q int, id bigint, rank int, neighbour bigint, dist double")
    own = F.when(F.col("id") == F.col("neighbour"), 0).otherwise(1)
    some = some.select("id", "q", F.struct(own.alias("o"), "dist", "neighbour").alias("x"))
    while True:
        best = some.groupBy("id", F.floor(F.col("q") / MERGED).cast("int").alias("q")).agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("a"))
        if g <= MERGED:
            return best.select("id", F.posexplode("a").alias("rank", "x")).select("id", "rank", F.col("x.neighbour").alias("neighbour"), F.col("x.dist").alias("dist"))
        some, g = best.select("id", "q", F.explode("a").alias("x")), math.ceil(g / MERGED)
