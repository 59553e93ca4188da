"""Token ids as flat binary files with 64-bit document offsets, written in parallel and read by memory mapping.

Format, for each shard: `<name>.ids` holds unsigned little-endian integers (16 bits if the vocabulary's ids fit, else
32), `<name>.idx` n + 1 unsigned 64-bit offsets of the documents in it, `<name>.doc` n signed 64-bit document ids.
`manifest.json` lists the shards in order with the id width and each shard's base, the count of all ids before it:
the bases are the prefix sums of the shards' counts, so no task needs another's result to write.

Documents are range-partitioned by doc_id, ties by a hash of the text and by row, so that repeated ids are no limit to
splitting; within a partition they are sorted and streamed batch by batch to the file. Files carry a fresh name per
task attempt; only those of the attempt whose result Spark accepts are in the manifest, so a lost executor or a
speculative copy leaves at worst an unlisted file. The driver holds one row per shard.

Defined results: null and empty texts give the end id alone. A null doc_id sorts first and is read back as null.
Repeated rows are written each, in any order among themselves; documents of one id go by a hash of their text. A very
long text is encoded whole. An empty table gives a manifest without shards. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .chunks import Chunks, joinable

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BATCH_IDS = 1 << 20


class Encoder:
    """Encodes chunks of byte-level BPE text with the tokenizers library."""

    def __init__(self, raw: bytes, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = not special  # their strings in a text are then ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # one character of a byte-level token stands for one byte
        self.lengths = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)])
        self.chunks = Chunks(self._chunks, self.dtype)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, names: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Chunks that open with a boundary are encoded in long runs, which are cut by the tokens' byte lengths."""
        runs, alone = [], []
        for name in names:
            (runs if joinable(name) else alone).append(name)
        order, flat, counts = [], [], []
        for k in range(0, len(runs), 2000):
            some = runs[k : k + 2000]
            ids = np.array(self._ids([b"".join(some).decode()])[0], np.int64)
            ends, at = np.cumsum([len(c) for c in some]), np.cumsum(self.lengths[ids])
            cut = np.searchsorted(at, ends)
            if cut[-1] == len(ids) - 1 and (at[cut] == ends).all():
                order += some
                flat.append(ids)
                counts.append(np.diff(cut, prepend=-1))
            else:
                alone += some
        for k in range(0, len(alone), 1000):
            some = alone[k : k + 1000]
            found = self._ids([c.decode() for c in some])
            order += some
            flat.append(np.array([x for ids in found for x in ids], np.int64))
            counts.append(np.array([len(ids) for ids in found], np.int64))
        return order, np.concatenate(flat).astype(self.dtype), np.concatenate(counts)


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    key, raw = vocabulary.value
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_SHARD = "pid int, name string, n_docs bigint, n_ids bigint, n_null bigint, first bigint, last bigint"


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = END_ID) -> dict:
    """Writes the files and the manifest below folder, a URI that driver and executors share; returns the manifest."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        raw = f.read()
    vocabulary = spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, files, row = _encoder(vocabulary), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                place, at = _place(folder)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                place.create_dir(at, recursive=True)
                files = [place.open_output_stream(f"{at}/{name}.{kind}") for kind in ("ids", "idx", "doc")]
                files[1].write(np.zeros(1, "<u8").tobytes())
                row = {"pid": TaskContext.get().partitionId(), "name": name, "n_docs": 0, "n_ids": 0, "n_null": 0, "first": None, "last": None}
            stops, n_ids = [], row["n_ids"]
            for ids, first in encoder.chunks.each(batch.column(1)):
                if end_id is not None:
                    ids, first = np.insert(ids, first[1:], end_id), first + np.arange(len(first))
                files[0].write(ids.tobytes())
                stops.append(n_ids + first[1:])
                n_ids += len(ids)
            files[1].write(np.concatenate(stops).astype("<u8").tobytes())
            files[2].write(np.asarray(batch.column(0).fill_null(0), "<i8").tobytes())
            known = batch.column(0).drop_null()
            row |= {"n_docs": row["n_docs"] + batch.num_rows, "n_ids": int(n_ids), "n_null": row["n_null"] + batch.column(0).null_count}
            if len(known):
                row |= {"first": known[0].as_py() if row["first"] is None else row["first"], "last": known[-1].as_py()}
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("pid", pa.int32()), ("name", pa.string()), *((k, pa.int64()) for k in ("n_docs", "n_ids", "n_null", "first", "last"))]))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    keys = ["id", "h", "k"]
    dealt = rows.withColumns({"h": F.xxhash64("text"), "k": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    shards = sorted((r.asDict() for r in dealt.select("id", "text").mapInArrow(shard, _SHARD).collect()), key=lambda r: r["pid"])
    base, last = 0, None
    for s in shards:
        s["base"] = base
        base += s["n_ids"]
        if s["first"] is not None:
            if last is not None and s["first"] < last:
                raise RuntimeError("shards are not in ascending order")
            last = s["last"]
    manifest = {"width": Encoder(raw).dtype.itemsize, "n_ids": base, "shards": shards}
    place, at = _place(folder)
    place.create_dir(at, recursive=True)
    with place.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class _Remote:
    """An array in a file that can't be mapped: slices are read when they are asked for."""

    def __init__(self, place: pafs.FileSystem, path: str, dtype: str):
        self.file, self.dtype = place.open_input_file(path), np.dtype(dtype)

    def __getitem__(self, own: slice) -> np.ndarray:
        n = (own.stop - own.start) * self.dtype.itemsize
        return np.frombuffer(self.file.read_at(n, own.start * self.dtype.itemsize) if n else b"", self.dtype)


def mapped(place: pafs.FileSystem, path: str, dtype: str) -> np.ndarray | _Remote:
    """The file as an array: mapped where the file system is local, else read by slices."""
    if place.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    return _Remote(place, path, dtype)


def read(spark: SparkSession, folder: str, ids: bool = True, crc: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens; its ids and their crc32 as 32-bit integers."""
    place, at = _place(folder)
    with place.open_input_file(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = f"<u{manifest['width']}"
    wanted = ["doc_id bigint", "start bigint", "n_tokens bigint", *["ids array<bigint>"] * ids, *["ids_crc32 bigint"] * crc]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = _place(folder)
        for batch in batches:
            for s in batch.to_pylist():
                flat, idx, doc = (mapped(place, f"{at}/{s['name']}.{kind}", t) for kind, t in (("ids", dtype), ("idx", "<u8"), ("doc", "<i8")))
                hi = 0
                while hi < s["n_docs"]:
                    lo = hi
                    own = idx[lo : min(lo + 1000, s["n_docs"]) + 1].astype(np.int64)
                    # a batch holds so many ids at most, or one document
                    own = own[: max(2, int(np.searchsorted(own, own[0] + BATCH_IDS, "right")))]
                    hi = lo + len(own) - 1
                    cols = [pa.array(doc[lo:hi], pa.int64(), mask=np.arange(lo, hi) < s["n_null"]), pa.array(own[:-1] + s["base"]), pa.array(np.diff(own))]
                    if ids:
                        cols.append(pa.LargeListArray.from_arrays(pa.array(own - own[0]), pa.array(flat[own[0] : own[-1]].astype(np.int64))).cast(pa.list_(pa.int64())))
                    if crc:
                        wide = flat[own[0] : own[-1]].astype("<u4")
                        cols.append(pa.array([zlib.crc32(wide[a - own[0] : b - own[0]]) for a, b in zip(own[:-1], own[1:], strict=True)], pa.int64()))
                    yield pa.RecordBatch.from_arrays(cols, names=[w.split()[0] for w in wanted])

    shards = [(s["name"], s["n_docs"], s["n_null"], s["base"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "name string, n_docs bigint, n_null bigint, base bigint")
    return listed.repartition(max(1, len(shards))).mapInArrow(documents, ", ".join(wanted))


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared.work_dir(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(spark, folder, ids=False, crc=True)


QUERIES = {"op9_token_files": op9_token_files}
