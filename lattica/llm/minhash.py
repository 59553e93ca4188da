"""Near-duplicates by b-bit MinHash with exact confirmation.

A document's set holds its distinct shingles of five words. Documents with 100 * intersection >= 75 * union link;
the result has each document's smallest reachable doc_id.

1. Sketch: every text once, to its set's size and two 64-bit sums that identify the set, the minima of 128 hashes as
   4-bit lanes packed in eight longs, and 32 band keys of four full minima. One narrow pass, written once. A shingle
   is a 64-bit number made of its words' identities (`textkit.digests`), so sets of m and n different shingles seem to
   share one with probability m * n / 2**64, and different sets seem equal with 2**-128.
2. Classes: texts of equal sets are one class, represented by its smallest doc_id, so a group of copies of any size
   is one row from here on (map-side combined minimum).
3. Bands: representatives with a band key in common are candidates. Each bucket is held as a star to its smallest
   member, never as all its pairs; members meet it in a merge join, whose hot keys adaptive execution splits. Sizes and the collision-corrected estimate from the packed lanes (a lane differs
   where an XOR leaves a bit; a chance collision has probability 1/16) drop what cannot link.
4. Confirm: each representative with its best centre, then star links between components, on full sets.
5. Rest: buckets that still hold several components are settled in blocks of at most 2 * BLOCK members: the lanes
   of all pairs across components are compared in numpy, members with a partner above the cut get their sets, and
   pairs are confirmed best first with a union-find, so only a forest of confirmed links leaves a block.
6. Components: pointer doubling over the stars, then large-star/small-star over what the blocks add.

No candidate is capped: every pair that shares a bucket is either in one component or has been compared. A pair of
similarity 0.75 shares none of 32 bands with probability 5e-6, and falls below the cut (6 standard errors) with 1e-9.

Defined results: null and empty texts and texts without words have an empty set, link with nothing and are kept. Fewer
words than five are one shingle. Rows that share a doc_id are one node, whatever their texts. A null doc_id links with
nothing and is kept. A very long text is one row like any other, hashed whole in a batch of its own. Of equal sets the
smallest id represents them all, and ties between centres go to the smallest. Extra columns are not read, whatever their
names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components
from . import textkit as tk
from .shared import bounded_batches, free_name, table, written

SHINGLE = 5
K, BANDS, BITS = 128, 32, 4
LANES = 64 // BITS
LONGS = K // LANES
CUT = 0.5
BLOCK = 2048
#: So many ids (8 bytes each) are broadcast at most, after they have been counted; more are joined by shuffle.
BROADCAST_IDS = 500_000
NUMERATOR, DENOMINATOR = 75, 100
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)
_LOW = np.uint64(0x1111111111111111)
_CHANCE = 2.0**-BITS
#: Fewest equal lanes of an estimate at the cut.
LEAST_EQUAL = int(np.ceil(K * (_CHANCE + (1 - _CHANCE) * CUT)))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the n + 1 offsets of the rows in them."""
    words = tk.words_of(data, offsets, tk.SPACES, fold=True)
    n, own_hash = len(offsets) - 1, tk.digests(words)
    at, h = tk.windows(words, SHINGLE, own_hash)
    row = words.row[at]
    few = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < SHINGLE))
    if len(few):
        own = np.empty(len(few), np.uint64)
        for k, r in enumerate(few):
            x = int(words.first[r + 1] - words.first[r])
            for w in own_hash[words.first[r] : words.first[r + 1]].tolist():
                x = (x * 0x9FB21C651E98DF25 + w) % (1 << 64)
            own[k] = x
        row, h = np.concatenate((row, few)), np.concatenate((h, tk.mix(own)))
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    first = np.searchsorted(row, np.arange(n + 1))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        h[lo:hi].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K minima of each row that has shingles; rows by hashes."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), K), np.uint32)
    v = np.empty(len(x), np.uint32)
    for k in range(K if len(at) else 0):
        np.multiply(x, _A[k], out=v)
        np.add(v, _B[k], out=v)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, LANES to a long."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), LONGS, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(m: np.ndarray) -> np.ndarray:
    """BANDS hashes of each row's minima, the band's number mixed in."""
    r = m.reshape(len(m), BANDS, K // BANDS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for k in range(r.shape[2]):
        key = tk.mix(key * np.uint64(0x9FB21C651E98DF25) + r[:, :, k])
    return key


_SIGNATURE = [f"s{k}" for k in range(LONGS)]
_SKETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "h1", "h2", *_SIGNATURE)] + [T.StructField("bands", T.ArrayType(T.LongType()))])


def _sketch_rows(texts: pa.Array) -> pa.Array:
    data, offsets = tk.column_bytes(texts)
    cols: list[list[np.ndarray]] = [[] for _ in range(3 + LONGS)]
    bands = []
    for lo, hi in tk.groups(offsets):
        h, first = shingles(data, offsets[lo : hi + 1])
        n = np.diff(first)
        some = np.flatnonzero(n)
        m = minima(h, first)
        put = [n]
        for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
            total = np.zeros(len(n), np.uint64)
            if len(some):
                total[some] = np.add.reduceat(tk.mix(h * np.uint64(salt)), first[some])
            put.append(total.view(np.int64))
        lanes = np.zeros((len(n), LONGS), np.uint64)
        lanes[some] = packed(m)
        for c, v in zip(cols, [*put, *lanes.view(np.int64).T], strict=True):
            c.append(v.astype(np.int64))
        keys = np.zeros((len(n), BANDS), np.uint64)
        keys[some] = band_keys(m)
        bands.append(keys.view(np.int64).reshape(-1))
    flat = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in cols]
    rows = len(texts)
    at = pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS)
    flat.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))))
    return pa.StructArray.from_arrays(flat, names=_SKETCH.fieldNames())


@F.arrow_udf(_SKETCH)
def _sketch(texts: pa.Array) -> pa.Array:
    return _sketch_rows(texts)


@F.arrow_udf(T.BinaryType())
def _set_of(texts: pa.Array) -> pa.Array:
    data, offsets = tk.column_bytes(texts)
    out = []
    for lo, hi in tk.groups(offsets):
        h, first = shingles(data, offsets[lo : hi + 1])
        out += [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    return pa.array(out, pa.binary())


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return len(x) > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


@F.arrow_udf(T.BooleanType())
def _confirmed(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_similar(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


def equal_lanes(a: str, b: str) -> Column:
    """How many of the K lanes of two packed signatures are equal, by bit counts."""
    total = F.lit(K)
    for c in _SIGNATURE:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total - F.bit_count(x.bitwiseAND(F.lit(int(_LOW))))
    return total


def _close_sizes(a: str, b: str) -> Column:
    return F.expr(f"{DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b})")


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of the rows with those ids; texts are shuffled only where the ids are too many to broadcast."""
    ids = written(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    own = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return written(own.select("id", _set_of.asNondeterministic()("text").alias("set")), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    got = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return got.where(_confirmed.asNondeterministic()("set_a", "set_b")).select("a", "b").distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows of equal keys in sorted batches."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        cols = [np.asarray(now[k]) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        at = [0, *cut.tolist()]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield now.slice(lo, hi - lo)
        rest = now.slice(at[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


_GROUP = ["key", "i", "j"]


def _open_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a block across components, of close sizes and with an estimate above the cut; equal lanes."""
    root, n, side = (np.asarray(t[c]) for c in ("root", "n", "side"))
    lanes = np.stack([np.asarray(t[c]).view(np.uint64) for c in _SIGNATURE], axis=1)
    one_block = t["i"][0].as_py() == t["j"][0].as_py()
    left = np.arange(len(root)) if one_block else np.flatnonzero(side == t["i"][0].as_py())
    right = left if one_block else np.flatnonzero(side != t["i"][0].as_py())
    out = []
    for lo in range(0, len(left), 64):
        a = left[lo : lo + 64]
        ok = (root[a][:, None] != root[right][None, :]) & (DENOMINATOR * np.minimum.outer(n[a], n[right]) >= NUMERATOR * np.maximum.outer(n[a], n[right]))
        if one_block:
            ok &= a[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        x, y = a[x], right[y]
        d = lanes[x] ^ lanes[y]
        d |= d >> np.uint64(2)
        d |= d >> np.uint64(1)
        same = K - np.bitwise_count(d & _LOW).sum(axis=1, dtype=np.int64)
        keep = same >= LEAST_EQUAL
        out.append((x[keep], y[keep], same[keep]))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches, _GROUP):
        x, y, _ = _open_pairs(t)
        if len(x):
            yield from t.take(np.unique(np.concatenate((x, y)))).combine_chunks().to_batches()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirms open pairs, best first; emits the links that join components not yet joined in the block."""
    for t in _grouped(batches, _GROUP):
        x, y, same = _open_pairs(t)
        root, sets = t["root"].to_pylist(), t["set"]
        above: dict[int, int] = {}

        def find(v):
            while v in above:
                v = above[v]
            return v

        a, b = [], []
        for k in np.argsort(-same, kind="stable"):
            p, q = find(root[x[k]]), find(root[y[k]])
            if p != q and _similar(sets[int(x[k])].as_py(), sets[int(y[k])].as_py()):
                above[max(p, q)] = min(p, q)
                a.append(p)
                b.append(q)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    sketch = written(rows.select("id", _sketch.asNondeterministic()("text").alias("x")).select("id", "x.*"), "sketch")
    classes = written(sketch.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")).where("rep is not null"), "classes")
    own = sketch.withColumnRenamed("id", "rep").join(classes, ["h1", "h2", "n", "rep"], "left_semi")
    reps = written(own.select("rep", "n", *_SIGNATURE, "bands").dropDuplicates(["rep", "n", *_SIGNATURE]), "representatives")
    lanes = reps.select("rep", "n", *_SIGNATURE)
    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("most"), F.count("*").alias("c")).where("most > centre").drop("most")
    members = written(keys.join(buckets.hint("merge"), "key"), "members")

    stars = members.where("rep != centre").groupBy("rep", "centre").agg(F.count("*").alias("shared"))
    judged = stars.join(lanes.alias("x"), "rep").join(lanes.alias("y").withColumnRenamed("rep", "centre"), "centre").where(_close_sizes("x.n", "y.n"))
    judged = judged.select("rep", "centre", equal_lanes("x", "y").alias("same")).where(F.col("same") >= LEAST_EQUAL)
    stars = written(judged.groupBy("rep", "centre").agg(F.max("same").alias("same")), "stars")

    open_ids = stars.select(F.explode(F.array("rep", "centre")).alias("id")).distinct()
    sets = _sets(rows, open_ids)
    best = stars.groupBy("rep").agg(F.max(F.struct("same", -F.col("centre"))).alias("m")).select(F.col("rep").alias("a"), (-F.col("m.col2")).alias("b"))
    parents = _confirm(best, sets).select(F.col("a").alias("node"), F.col("b").alias("parent"))
    rooted = components.roots(parents)

    def with_roots(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(rooted.select(F.col("node").alias(column), F.col("root").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))

    tried = stars.join(best.select(F.col("a").alias("rep"), F.col("b").alias("centre")), ["rep", "centre"], "left_anti")
    across = with_roots(with_roots(tried, "rep", "p"), "centre", "q").where("p != q")
    links = _confirm(across.select(F.col("rep").alias("a"), F.col("centre").alias("b")), sets)
    more = with_roots(with_roots(links, "a", "p"), "b", "q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    joined = components.components(more)
    rooted = written(_relabelled(rooted, joined), "rooted")

    parted = with_roots(members.where("c > 2").drop("centre"), "rep", "root")
    unsettled = written(parted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "unsettled")
    few = unsettled.count() <= BROADCAST_IDS
    dealt = parted.join(F.broadcast(unsettled) if few else unsettled.hint("merge"), "key", "left_semi").join(lanes, "rep")
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "root", "n", *_SIGNATURE)
    schema = dealt.schema
    open_rows = written(dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_open_members, schema), "open")
    missing = open_rows.select(F.col("rep").alias("id")).distinct().join(sets, "id", "left_anti")
    sets = sets.union(_sets(rows, missing))
    full = open_rows.join(sets.withColumnRenamed("id", "rep"), "rep").select(*schema.names, "set")
    found = full.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_settle, "a bigint, b bigint")
    rooted = written(_relabelled(rooted, components.components(found)), "rooted")

    repeated = _repeated_ids(sketch, classes)
    if repeated is not None:
        least = repeated.groupBy("id").agg(F.min("rep").alias("a"))
        ties = with_roots(with_roots(repeated.join(least, "id").where("rep != a"), "a", "p"), "rep", "q").select(F.col("p").alias("a"), F.col("q").alias("b"))
        rooted = written(_relabelled(rooted, components.components(ties)), "rooted")
    named = classes.join(rooted.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("component"))
    out = sketch.select("id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    if repeated is not None:  # rows of such an id that have no shingles
        whole = with_roots(repeated, "rep", "root").groupBy("id").agg(F.min("root").alias("whole"))
        out = out.join(whole, "id", "left").withColumn("component", F.coalesce("whole", "component"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeated_ids(sketch: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(id, rep) of the ids whose rows have different sets: each with the representatives of its classes."""
    one = F.struct("n", "h1", "h2")
    many = written(sketch.where("id is not null").groupBy("id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo != hi").select("id"), "repeated")
    if many.isEmpty():
        return None
    own = sketch.where("n > 0").join(many, "id", "left_semi").select("id", "n", "h1", "h2").distinct()
    return written(own.join(classes, ["h1", "h2", "n"]).select("id", "rep").distinct(), "repeated")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns; of rows that repeat an id, one of the smallest text hash.

    A row without an id is kept.
    """
    key, n, whole = (free_name(docs, c) for c in ("id", "n", "row"))
    gone = near_duplicates(docs, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    rest = docs.join(gone, F.col(doc_id) == F.col(key), "left_anti")
    many = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(key)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(key)
    if many.isEmpty():
        return rest
    once = rest.join(many, F.col(doc_id) == F.col(key), "left_anti")
    first = rest.join(many, F.col(doc_id) == F.col(key), "left_semi").groupBy(F.col(doc_id).alias(key))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return once.unionByName(first.agg(F.min_by(row, F.struct(F.xxhash64(text), F.length(text))).alias(whole)).select(f"{whole}.*"))


def _relabelled(rooted: DataFrame, joined: DataFrame) -> DataFrame:
    """rooted with roots replaced by what joined (root, lower root) says, and rows for the replaced roots themselves."""
    higher = joined.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    moved = rooted.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return moved.union(joined.select("node", "root"))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash": op2_minhash}
