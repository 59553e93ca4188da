"""Edit-aware token counts.

A document's pre-tokens are kept as the leaves of a segment tree that sums characters and tokens. An edit finds its
place by descending on characters, re-encodes from the first pre-token that could have read the edited place to the
first old boundary behind it, and updates the sums above the blocks it touched. The pattern never looks behind, so
from a boundary that old and new splits share everything after is the same; and no match reads more than CONTEXT
characters past its end, so what ends that far before an edit stays.

Leaves are grouped in blocks of BLOCK pre-tokens; a block that grows fourfold has the tree dealt anew. Only a tree's
leaves are stored (packed lengths and counts); sums are made again on loading, without encoding.

Edits are (pos, del, ins) in code points, applied in order, each to the text its predecessors left. Defined results: a
null text is empty; null edits are none; a position or length beyond the text is cut to it; negative values count as
0; a null insertion is empty; edits of one place apply in order. Repeated rows are counted each. A very long text is one
tree, built and edited whole in a batch of its own. An empty table gives an empty result. Extra columns pass through;
where one has the name of the new column, the new one takes an underscore in front (`free_name`). Rows stay where they are.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .shared import free_name, table

VOCABULARY = "byte_bpe_50k.tiktoken"
CONTEXT = 3
BLOCK = 64
EDITS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("del", T.LongType()), T.StructField("ins", T.StringType())]))


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, raw: bytes, limit: int = 500_000):
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("pre-tokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{bpe._WHITE}").replace(r"\s", f"[{bpe._WHITE}]").replace(r"\S", f"[^{bpe._WHITE}]")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= self.limit:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = n
        return n


class Tree:
    """Pre-tokens of a text in blocks, and a segment tree of (characters, tokens) over the blocks."""

    def __init__(self, text: str, lengths: list[int], counts: list[int]):
        self.text = text
        self._deal(lengths, counts)

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        pieces = counter.pattern.findall(text)
        return cls(text, list(map(len, pieces)), list(map(counter, pieces)))

    @classmethod
    def load(cls, text: str, leaves: bytes) -> Tree:
        both = np.frombuffer(leaves, "<u4").reshape(2, -1)
        return cls(text, both[0].tolist(), both[1].tolist())

    def leaves(self) -> bytes:
        return np.array([[x for b in part for x in b] for part in (self.lengths, self.counts)], "<u4").tobytes()

    def _deal(self, lengths: list[int], counts: list[int]) -> None:
        at = range(0, max(1, len(lengths)), BLOCK)
        self.lengths = [lengths[k : k + BLOCK] for k in at]
        self.counts = [counts[k : k + BLOCK] for k in at]
        self.width = 1 << max(0, len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k in range(len(self.lengths)):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(self.lengths[k]), sum(self.counts[k])
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _put(self, block: int) -> None:
        k = self.width + block
        self.chars[k], self.tokens[k] = sum(self.lengths[block]), sum(self.counts[block])
        while k := k >> 1:
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The block that holds the character at pos (the last block beyond the end), and where it starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if pos - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return min(k - self.width, len(self.lengths) - 1), start

    def edit(self, pos: int, cut: int, ins: str, counter: Counter) -> int:
        """Replaces cut characters at pos by ins; returns how many pre-tokens were encoded."""
        pos = min(max(0, pos), len(self.text))
        cut = min(max(0, cut), len(self.text) - pos)
        if not cut and not ins:
            return 0
        text = self.text[:pos] + ins + self.text[pos + cut :]
        first, at = self._find(max(0, pos - CONTEXT))
        while first and at > max(0, pos - CONTEXT):  # beyond the end or after empty blocks
            first -= 1
            at -= self.chars[self.width + first]
        keep = 0
        while keep < len(self.lengths[first]) and at + self.lengths[first][keep] + CONTEXT <= pos:
            at += self.lengths[first][keep]
            keep += 1
        # new pre-tokens from there, until one ends where an old one did, behind the edit
        shift, block, leaf, old = len(ins) - cut, first, keep, at
        new_lengths: list[int] = []
        new_counts: list[int] = []
        now = at
        for m in counter.pattern.finditer(text, at):
            new_lengths.append(m.end() - m.start())
            new_counts.append(counter(m.group()))
            now = m.end()
            if now < pos + len(ins):
                continue
            while old < now - shift or old < pos + cut:
                while leaf >= len(self.lengths[block]):
                    block, leaf = block + 1, 0
                old += self.lengths[block][leaf]
                leaf += 1
            if old == now - shift:
                break
        else:
            block, leaf = len(self.lengths) - 1, len(self.lengths[-1])
        tail = (self.lengths[block][leaf:], self.counts[block][leaf:])
        for k in range(first + 1, block + 1):
            self.lengths[k], self.counts[k] = [], []
        self.lengths[first] = self.lengths[first][:keep] + new_lengths + tail[0]
        self.counts[first] = self.counts[first][:keep] + new_counts + tail[1]
        self.text = text
        if len(self.lengths[first]) > 4 * BLOCK:
            self._deal([x for b in self.lengths for x in b], [x for b in self.counts for x in b])
        else:
            for k in range(first, block + 1):
                self._put(k)
        return len(new_lengths)

    def apply(self, edits: list[dict] | None, counter: Counter) -> int:
        return sum(self.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "", counter) for e in edits or () if e)


_counters: dict[str, Counter] = {}


def _counter(shared) -> Counter:
    key, raw = shared.value
    if key not in _counters:
        _counters[key] = Counter(raw)
    return _counters[key]


def _share(spark, path: str | None):
    return bpe.share(spark, path or public_tokenizers.path(VOCABULARY))


def trees(docs: DataFrame, text: str = "text", out: str = "tree", path: str | None = None) -> DataFrame:
    """Appends each text's tree: its tokens and packed leaves."""
    shared = _share(docs.sparkSession, path)

    @F.arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("leaves", T.BinaryType())]))
    def made(texts: pa.Array) -> pa.Array:
        own = [Tree.of(t or "", _counter(shared)) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t.n_tokens for t in own], pa.int64()), pa.array([t.leaves() for t in own], pa.binary())], names=["n_tokens", "leaves"])

    return docs.select("*", made.asNondeterministic()(F.col(text)).alias(free_name(docs, out)))


def apply_edits(docs: DataFrame, edits: str = "edits", text: str = "text", tree: str = "tree", out: str = "edited", path: str | None = None) -> DataFrame:
    """Appends the edited text, its tree, and how many pre-tokens were encoded again; nothing else is."""
    shared = _share(docs.sparkSession, path)
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("leaves", T.BinaryType()), T.StructField("n_encoded", T.LongType())])

    @F.arrow_udf(kind)
    def edited(texts: pa.Array, leaves: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for t, x, e in zip(texts.to_pylist(), leaves.to_pylist(), lists.to_pylist(), strict=True):
            own = Tree.load(t or "", x) if x is not None else Tree.of(t or "", _counter(shared))
            n = own.apply(e, _counter(shared))
            rows.append((own.text, own.n_tokens, own.leaves(), n))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=kind.fieldNames())

    return docs.select("*", edited.asNondeterministic()(F.col(text), F.col(f"{tree}.leaves"), F.col(edits).cast(EDITS)).alias(free_name(docs, out)))


def counts(docs: DataFrame, edits: str = "edits", text: str = "text", out: str = "counts", path: str | None = None) -> DataFrame:
    """Appends tokens before and after the edits, pre-tokens, and pre-tokens encoded again, building and editing trees in place."""
    shared = _share(docs.sparkSession, path)
    names = ["n_before", "n_after", "n_pretokens", "n_encoded"]

    @F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in names]))
    def counted(texts: pa.Array, lists: pa.Array) -> pa.Array:
        counter, rows = _counter(shared), []
        for t, e in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            own = Tree.of(t or "", counter)
            n, size = own.n_tokens, sum(map(len, own.lengths))
            encoded = own.apply(e, counter)
            rows.append((n, own.n_tokens, size, encoded))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select("*", counted.asNondeterministic()(F.col(text), F.col(edits).cast(EDITS)).alias(free_name(docs, out)))


def planned_edits(doc_id: str = "doc_id", text: str = "text"):
    """Three edits of a document that its id and length decide: an insertion, a deletion, a replacement."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), n + 1).cast("bigint")
    edit = lambda pos, cut, ins: F.struct(pos.alias("pos"), F.lit(cut).cast("bigint").alias("del"), F.lit(ins).alias("ins"))
    return F.array(edit(at(1), 0, "inserted words, it's 42 "), edit(at(2), 17, ""), edit(at(3), 5, "\n\n  x"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", planned_edits())
    return counts(docs).select("doc_id", "counts.*")


QUERIES = {"op7_token_counts": op7_token_counts}
