"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from the vocabulary.

A rank file's tokens are byte strings. Every byte becomes one character (U+0100 + byte), every token a piece of such
characters with score -rank, and the model is written as a protocol buffer by hand: model type BPE, identity
normalisation, no dummy prefix, no white-space escapes. sentencepiece merges the neighbours whose joined piece
scores highest, leftmost first, which is the merge of lowest rank. Text is cut into pre-tokens by the pattern; a
pre-token that is a token itself is taken whole, as tiktoken does. Decoding maps ids to pieces and characters to bytes.

The vocabulary (about 1 MB) is read on the driver from a path parameter and broadcast. Rows are handled where they
are, so nothing is shuffled.

Defined results: a null text encodes like an empty one, to no ids, and decodes to no bytes; null ids decode to no bytes.
Repeated rows are encoded each by itself; of merges of one rank the leftmost comes first. A very long text is encoded
whole, in a batch of its own (its pre-tokens are cut as the pattern says, so a long run without a boundary is one). An
empty table gives an empty result. Extra columns pass through; where one has the name of a new column, the new one takes an
underscore in front (`free_name`). Unknown ids cannot be decoded and raise.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Chunks
from .shared import bounded_batches, free_name

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEPT_CHUNKS = 500_000
_SHIFT = 0x100
_TO_CHAR = {b: _SHIFT + b for b in range(256)}
#: White space as the Unicode property has it, whatever the regex library adds to \\s.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHAR)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece takes the next free id."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    pieces = [_field(1, mapped(t).encode()) + _field(2, -float(r)) for t, r in by_rank]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.pieces = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")).findall
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.chunks = Chunks(self._chunks, self.dtype, KEPT_CHUNKS)

    def _chunks(self, names: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        tokens = [[t.encode() for t in self.split(c.decode())] for c in names]
        new = sorted({t for ts in tokens for t in ts if t not in self.ranks})
        made = dict(zip(new, self.model.encode([mapped(t) for t in new], num_threads=1), strict=True)) if new else {}
        ranks = self.ranks
        ids = [[x for t in ts for x in ((ranks[t],) if t in ranks else made[t])] for ts in tokens]
        return names, np.fromiter(chain.from_iterable(ids), self.dtype), np.array(list(map(len, ids)), np.int64)

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return self.chunks.rows(texts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def _listed(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int32), *arrays], dtype=np.int32)))


_codecs: dict[str, Codec] = {}


def codec_of(shared) -> Codec:
    key, raw = shared.value
    if key not in _codecs:
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})
    return _codecs[key]


def share(spark, path: str):
    """The vocabulary file as a broadcast: its size is that of the file, whatever the corpus."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def vocabulary(path: str | None = None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Appends the ids of each text."""
    shared = share(docs.sparkSession, vocabulary(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return _listed(list(codec_of(shared).encode_batch(texts)))

    return docs.select("*", ids.asNondeterministic()(F.col(text)).alias(free_name(docs, out)))


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Appends the bytes that each array of ids stands for."""
    shared = share(encoded.sparkSession, vocabulary(path))

    @F.arrow_udf(T.BinaryType())
    def back(col: pa.Array) -> pa.Array:
        codec = codec_of(shared)
        return pa.array([codec.decode(x or ()) for x in col.to_pylist()], pa.binary())

    return encoded.select("*", back.asNondeterministic()(F.col(ids)).alias(free_name(encoded, out)))


_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, text: str = "text", out: str = "digests", path: str | None = None, ids: str | None = None) -> DataFrame:
    """Appends digests of what `encode` and `decode` give, made where they are made, so no id leaves Python.

    ids: also append the ids themselves as a column of that name.
    """
    shared = share(docs.sparkSession, vocabulary(path))
    kind = T.StructType([*_DIGESTS.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    @F.arrow_udf(kind)
    def both(texts: pa.Array) -> pa.Array:
        codec, n, sha, back, kept = codec_of(shared), [], [], [], []
        names = _decimals(len(codec.pieces))
        for got in codec.encode_batch(texts):
            n.append(len(got))
            sha.append(hashlib.sha256(",".join(map(names.__getitem__, got.tolist())).encode()).hexdigest())
            back.append(hashlib.sha256(codec.decode(got)).hexdigest())
            if ids:
                kept.append(got)
        cols = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        if ids:
            cols.append(_listed(kept))
        return pa.StructArray.from_arrays(cols, names=[f.name for f in kind.fields])

    out = free_name(docs, out)
    got = docs.select("*", both.asNondeterministic()(F.col(text)).alias(out))
    return got.withColumn(free_name(got, ids), F.col(f"{out}.ids")) if ids else got


_named: list[str] = []


def _decimals(n: int) -> list[str]:
    if len(_named) < n:
        _named[:] = map(str, range(n))
    return _named


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs).select("doc_id", "digests.*")


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
