"""Sources and sinks of points, labels and records."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "case_id string, block int, method string, route string, fit_ms double, ok boolean"


def _based(spark: SparkSession, path: str, width: int, wanted: int | None = None) -> DataFrame:
    """(content, base) of the files at path, in the order of their names: base counts the records of all files before.

    Each file holds whole records of `width` bytes and is one row (2 GB at most; `write_raw` writes smaller ones).
    """
    files = spark.read.format("binaryFile").load(path)
    found = sorted((r.path, r.length) for r in files.select("path", "length").collect())  # a row for each file
    size = sum(n for _, n in found)
    if wanted is not None and size != wanted:
        raise ValueError(f"{path} holds {size} bytes, not {wanted}")
    if odd := [p for p, n in found if n % width]:
        raise ValueError(f"{odd[0]} holds no whole number of {width} bytes")
    base, at = [], 0
    for p, n in found:
        base.append((p, at))
        at += n // width
    return files.join(F.broadcast(spark.createDataFrame(base, "path string, base bigint")), "path").select("content", "base")


def _records(based: DataFrame, dtype: str, shape: tuple[int, ...], columns, schema: str) -> DataFrame:
    """Rows that `columns` makes of 10 000 records at a time: their positions and an array of the dtype and shape."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, base in zip(batch["content"], batch["base"].to_pylist(), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype).reshape(-1, *shape)
                for lo in range(0, len(x), 10_000):
                    part = x[lo : lo + 10_000]
                    yield columns(np.arange(base + lo, base + lo + len(part)), part)

    return based.mapInArrow(decode, schema)


#: Types of flat arrays (fixed values) and the columns that hold them.
KINDS = {"float32": ("<f4", "double"), "float64": ("<f8", "double"), "int32": ("<i4", "int"), "int64": ("<i8", "bigint"), "uint32": ("<u4", "bigint"), "uint8": ("u1", "int")}


def read_typed(spark: SparkSession, path: str, kind: str, n: int | None = None) -> DataFrame:
    """(position, value) of flat little-endian arrays without a header; n values exactly, if given."""
    dtype, sql = KINDS[kind]
    width = np.dtype(dtype).itemsize
    wide = {"double": np.float64, "int": np.int32, "bigint": np.int64}[sql]
    columns = lambda at, x: pa.RecordBatch.from_arrays([pa.array(at), pa.array(x.astype(wide))], names=["position", "value"])
    return _records(_based(spark, path, width, None if n is None else n * width), dtype, (), columns, f"position bigint, value {sql}")


def read_raw(spark: SparkSession, path: str, n: int, d: int) -> DataFrame:
    """n x d row-major little-endian float32 without a header, in one file or several, of exactly that size, as points."""

    def columns(at: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.astype(np.float64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(at), v], names=["id", "v"])

    return _records(_based(spark, path, 4 * d, 4 * n * d), "<f4", (d,), columns, "id bigint, v array<double>")


def read_labels(spark: SparkSession, path: str, n: int, configs: int) -> DataFrame:
    """configs x n little-endian int32, configuration by configuration."""
    columns = lambda at, x: pa.RecordBatch.from_arrays([pa.array((at // n).astype(np.int32)), pa.array(at % n), pa.array(x)], names=["config", "id", "label"])
    return _records(_based(spark, path, 4, 4 * n * configs), "<i4", (), columns, "config int, id bigint, label int")


def _write_parts(rows: DataFrame, keys: list[str], pack, path: str, files: int | None) -> int:
    """Writes rows by ranges of the keys to `part-*` files in their order, each whole or not there; returns how many.

    A task writes under a name of its own; only those that Spark accepted are renamed, so a lost executor or a second
    attempt leaves nothing behind. files: how many, about; else as many as there are partitions. path is a URI that driver and executors share.
    """
    spark = rows.sparkSession
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, out, name = TaskContext.get().partitionId(), None, uuid.uuid4().hex
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                place, at = pafs.FileSystem.from_uri(draft)
                place.create_dir(at, recursive=True)
                out = place.open_output_stream(f"{at}/{name}")
            out.write(pack(batch))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([name])], names=["pid", "name"])

    dealt = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    made = sorted((r.pid, r.name) for r in dealt.mapInArrow(write, "pid int, name string").collect())  # a row for each file
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, name) in enumerate(made):
        if not fs.rename(hadoop(f"{draft}/{name}"), hadoop(f"{path.rstrip('/')}/part-{k:06d}")):
            raise OSError(f"could not place part {k} of {path}")
    fs.delete(hadoop(draft), True)
    return len(made)


def write_raw(points: DataFrame, path: str, files: int | None = None) -> int:
    """Points as row-major little-endian float32 in id order, what `read_raw` reads; returns the number of files."""
    return _write_parts(points.select("id", "v"), ["id"], lambda b: np.asarray(b["v"].flatten()).astype("<f4").tobytes(), path, files)


def write_raw_labels(labels: DataFrame, path: str, files: int | None = None) -> int:
    """Labels as int32 by configuration and id, what `read_labels` reads; returns the number of files."""
    return _write_parts(labels.select("config", "id", F.col("label").cast("int").alias("label")), ["config", "id"], lambda b: np.asarray(b["label"]).astype("<i4").tobytes(), path, files)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("config", "id", "label").repartitionByRange("config", "id").sortWithinPartitions("config", "id").write.parquet(path)


def from_columns(rows: DataFrame, id_column: str, *columns: str) -> DataFrame:
    return rows.select(F.col(id_column).cast("bigint").alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))


def from_array(rows: DataFrame, id_column: str, column: str, width: int | None = None) -> DataFrame:
    v = F.col(column).cast("array<double>")
    return rows.select(F.col(id_column).cast("bigint").alias("id"), (F.slice(v, 1, width) if width else v).alias("v"))


def _tree_hash(rows: DataFrame, about: Column) -> DataFrame:
    """One row, `sha256`: of what `about` says and, by id, of each row's own hash h, in buckets of 65 536 ids."""
    each = rows.select(F.floor(F.col("id") / 65536).alias("b"), "id", "h")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["h"])), ",")
    buckets = each.groupBy("b").agg(F.sha2(listed, 256).alias("h"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")
    return buckets.agg(F.sha2(F.concat_ws("|", about, F.coalesce(F.sum("n"), F.lit(0)).cast("string"), whole), 256).alias("sha256"))


@F.arrow_udf(T.StringType())
def _row_hash(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else hashlib.sha256(np.asarray(x, "<f8").tobytes()).hexdigest() for x in v.to_pylist()], pa.string())


def fingerprint(points: DataFrame) -> DataFrame:
    """One row, `sha256`: of type, shape and each row's little-endian bytes, by id; partitions don't matter."""
    rows = points.select("id", F.concat(F.size("v").cast("string"), F.lit("x"), _row_hash("v")).alias("h"))
    return _tree_hash(rows, F.lit("float64"))


def label_fingerprint(truth: DataFrame, label: str = "truth") -> DataFrame:
    return _tree_hash(truth.select("id", F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("h")), F.lit("int32"))


def write_failure(points: DataFrame, labels: DataFrame, manifest: dict, path: str) -> str:
    """A replayable failure: points by their hash (written once), labels and a manifest; returns the artifact's path."""
    sha = fingerprint(points).first().sha256
    spark = points.sparkSession
    points.write.mode("ignore").parquet(f"{path}/points/{sha}")
    body = json.dumps(manifest | {"schema": 2, "points": sha}, sort_keys=True)
    name = spark.range(1).select(F.sha2(F.lit(body), 256)).first()[0]
    labels.write.mode("ignore").parquet(f"{path}/failures/{name}/labels")
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("ignore").text(f"{path}/failures/{name}/manifest")
    return f"{path}/failures/{name}"


def read_failure(spark: SparkSession, artifact: str) -> tuple[DataFrame, DataFrame, dict]:
    """Points, labels and manifest of an artifact; the points' hash is verified."""
    manifest = json.loads(spark.read.text(f"{artifact}/manifest").first().value)
    if manifest.get("schema") not in (1, 2):
        raise ValueError(f"unknown schema {manifest.get('schema')}")
    top = artifact.rsplit("/failures/", 1)[0]
    points = spark.read.parquet(f"{top}/points/{manifest['points']}" if manifest["schema"] == 2 else f"{artifact}/points")
    if fingerprint(points).first().sha256 != manifest["points"]:
        raise ValueError("the points are not those of the manifest")
    return points, spark.read.parquet(f"{artifact}/labels"), manifest


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines of that schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_lines(records: DataFrame, keys: list[str]) -> DataFrame:
    """(value): JSON objects with sorted keys, in the order of keys."""
    return records.orderBy(*keys).select(F.to_json(F.struct(*sorted(records.columns))).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.option("header", True).csv(path)


def result_line(summary: DataFrame, **about) -> str:
    """One JSON line about a run: its configurations and what is said about it."""
    rows = [json.loads(r) for r in summary.orderBy("config").toJSON().collect()]  # a grid's configurations
    return json.dumps(about | {"configurations": rows}, sort_keys=True)
