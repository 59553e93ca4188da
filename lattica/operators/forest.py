"""Connected components of the core graphs of a whole grid.

For one count m let c(i) be the smallest radius index at which i is core, and w(i, j) = max(code, c(i), c(j)). The core
graph at radius e has exactly the links with w <= e, so the components at every radius are those of a minimum spanning
forest by w, cut at e. Partitions reduce their links to forests first (a link that closes a cycle there is never
needed); what is left has at most n - 1 links for each partition and count. `shared` does so without joins where core
radii can be broadcast, for whole partitions; otherwise `core_links` and `spanning` go by batches.

`from_forest` then merges per count, in one task for each, if the remaining links are at most LOCAL_LINKS (checked);
`by_rounds` is the way for more: radius by radius, the links of that radius are contracted to the roots so far and
joined by alternating large-star and small-star steps, all as joins and minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.stored import remove_table, written

LOCAL_LINKS = 4_000_000
#: Bytes of roots that every task may hold, and pairs it joins at once.
SHARED_BYTES, SOME = 64 << 20, 1 << 20


def core_links(table: DataFrame, core: DataFrame) -> DataFrame:
    """(mp_idx, i, j, w): links between points that are core at some radius."""
    a = core.select("mp_idx", F.col("id").alias("i"), F.col("c").alias("ci"))
    b = core.select("mp_idx", F.col("id").alias("j"), F.col("c").alias("cj"))
    return table.select("i", "j", "code").join(a, "i").join(b, ["mp_idx", "j"]).select("mp_idx", "i", "j", F.greatest("code", "ci", "cj").alias("w"))


def _kruskal(i: np.ndarray, j: np.ndarray, w: np.ndarray):
    """Links of a minimum spanning forest, by w; roots are the smallest members."""
    above: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while (up := above.get(root, root)) != root:
            root = up
        while (up := above.get(v, v)) != v:
            above[v] = root
            v = up
        return root

    for k in np.argsort(w, kind="stable").tolist():
        p, q = find(int(i[k])), find(int(j[k]))
        if p != q:
            above[max(p, q)] = min(p, q)
            yield k, find


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, i, j, w = (np.asarray(batch[c]) for c in ("mp_idx", "i", "j", "w"))
        keep = []
        for v in np.unique(m):
            own = np.flatnonzero(m == v)
            keep += own[[k for k, _ in _kruskal(i[own], j[own], w[own])]].tolist()
        yield batch.take(pa.array(keep, pa.int64()))


def spanning(links: DataFrame) -> DataFrame:
    """The links that are left when every batch has become a forest."""
    return links.mapInArrow(_reduced, links.schema)


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots, the smallest members, after links p - q; root[root] must be root."""
    while True:
        p, q = root[p], root[q]
        apart = p != q
        if not apart.any():
            return root
        p, q = p[apart], q[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up


def shareable(n: int, counts: int, k: int) -> bool:
    """Whether every task may hold the core radii of n points and a root for each of them, count and radius."""
    return n * counts * max(16, 4 * k) <= SHARED_BYTES


def shared(table: DataFrame, core: DataFrame, k: int) -> DataFrame:
    """(mp_idx, i, j, w): links as those of `core_links` that a forest needs, found without a join.

    Core radii are broadcast (`shareable`). A task joins the links of all its pairs for each count and radius at which
    they begin, SOME pairs at a time, and tells a link of each root that vanishes to the one that takes its place.
    """
    got = core.select("mp_idx", "id", "c").toArrow()
    m, i, c = (np.asarray(x) for x in got.columns)
    ids = np.unique(i)
    since = np.full((int(m.max(initial=-1)) + 1, len(ids)), k, np.int32)
    since[m, np.searchsorted(ids, i)] = c
    told = table.sparkSession.sparkContext.broadcast((ids, since))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, since = told.value
        roots = {(m, e): np.arange(len(ids), dtype=np.int32) for m in range(len(since)) for e in range(k)}

        def absorb(some: list[pa.RecordBatch]) -> None:
            i, j, code = (np.concatenate([np.asarray(b[x]) for b in some]) for x in ("i", "j", "code"))
            a, b = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (i, j))
            known = (ids[a] == i) & (ids[b] == j)
            a, b, code = a[known], b[known], code[known]
            for m, own in enumerate(since):
                w = np.maximum(code, np.maximum(own[a], own[b]))
                for e in range(k):
                    new = w == e
                    roots[m, e] = _joined(roots[m, e], a[new], b[new])

        some, rows = [], 0
        for batch in batches:
            some, rows = [*some, batch], rows + batch.num_rows
            if rows >= SOME and len(ids):
                absorb(some)
                some, rows = [], 0
        if rows and len(ids):
            absorb(some)
        for m in range(len(since)):
            before = np.arange(len(ids), dtype=np.int32)
            for e in range(k):
                own = np.flatnonzero(roots[m, e] != np.arange(len(ids)))
                now = _joined(before, own, roots[m, e][own])
                gone = np.flatnonzero((before == np.arange(len(ids))) & (now != before))
                before = now
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gone), m, np.int32)), pa.array(ids[now[gone]]), pa.array(ids[gone]), pa.array(np.full(len(gone), e, np.int32))], names=["mp_idx", "i", "j", "w"])

    few = table.select("i", "j", "code").coalesce(table.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(reduce, "mp_idx int, i bigint, j bigint, w int")


def from_forest(core: DataFrame, forest: DataFrame, k: int) -> DataFrame:
    """(mp_idx, eps_idx, id, root) of the core points at k radii; one task for each count."""
    rows = core.select("mp_idx", F.col("id").alias("i"), F.lit(None).cast("bigint").alias("j"), F.col("c").alias("w")).unionByName(forest.select("mp_idx", "i", "j", "w"))

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, w = np.asarray(table["i"]), np.asarray(table["w"])
        link = np.asarray(table["j"].is_valid())
        node, since = i[~link], w[~link]
        order = np.argsort(node)
        node, since = node[order], since[order]
        a = np.searchsorted(node, i[link])
        b = np.searchsorted(node, np.asarray(table["j"].drop_null()))
        root = np.arange(len(node))
        out = []
        for e in range(k):
            now = w[link] == e
            p, q = root[a[now]], root[b[now]]
            root = _joined(np.arange(len(node)), p, q)[root]
            is_core = since <= e
            out.append(pa.table({"mp_idx": np.full(is_core.sum(), key[0].as_py(), np.int32), "eps_idx": np.full(is_core.sum(), e, np.int32), "id": node[is_core], "root": node[root[is_core]]}))
        return pa.concat_tables(out)

    return rows.groupBy("mp_idx").applyInArrow(settle, "mp_idx int, eps_idx int, id bigint, root bigint")


def connected(links: DataFrame, key: str) -> DataFrame:
    """(key, a, b) links to (key, node, root), the smallest node that is reachable, for all nodes but roots."""
    now = written(links.where("a != b").select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(20,0)"))).first())
        if state == last or not state[0]:
            return now.select(key, F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        both = now.select(key, "u", "v").union(now.select(key, F.col("v"), F.col("u")))
        low = both.groupBy(key, "u").agg(F.min("v").alias("m")).select(key, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(key, "u", "m"))
        before, now = now, written(small.where("u != v").distinct(), "links")
        remove_table(before)


def by_rounds(core: DataFrame, forest: DataFrame, k: int) -> DataFrame:
    """The same as `from_forest`, without a task that holds all of a count."""
    root = core.select("mp_idx", "id", F.col("id").alias("root"))
    out = None
    for e in range(k):
        now = forest.where(F.col("w") == e).select("mp_idx", "i", "j")
        for end in ("i", "j"):
            now = now.join(root.select("mp_idx", F.col("id").alias(end), F.col("root").alias(f"r{end}")), ["mp_idx", end])
        joined = connected(now.select("mp_idx", F.col("ri").alias("a"), F.col("rj").alias("b")), "mp_idx")
        higher = joined.select("mp_idx", F.col("node").alias("root"), F.col("root").alias("higher"))
        root = written(root.join(higher, ["mp_idx", "root"], "left").select("mp_idx", "id", F.coalesce("higher", "root").alias("root")), "roots")
        part = core.where(F.col("c") <= e).join(root, ["mp_idx", "id"]).select("mp_idx", F.lit(e).alias("eps_idx"), "id", "root")
        out = part if out is None else out.unionByName(part)
    return out


def components(core: DataFrame, links: DataFrame, k: int, local_links: int = LOCAL_LINKS) -> DataFrame:
    forest = written(links, "forest")
    few = forest.count() + core.count() <= local_links
    return from_forest(core, forest, k) if few else by_rounds(core, forest, k)
