"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII bytes. A word's subwords are itself and its
byte n-grams of 3 to 6 with end marks, hashed to buckets; so a misspelling that was never seen shares most vectors
with the word it varies. A text's vector is the mean of its words' vectors, each the mean of its subwords', and a
softmax layer over it gives the two classes. Embeddings and layer are trained together by Adam on whole texts.

As averaging and the layer are linear, scoring needs one number for each bucket: the model that is broadcast is a
table of 2**bits floats (1 MB) and a bias, whatever the corpus. Rows are scored where they are; nothing is shuffled.

Training reads at most about `sample` labelled rows (a documented bound; rows are chosen by a hash of their id, never
by their place), as words and counts made on the executors.

Defined results: null, empty and wordless texts get the score of the bias alone. Labels that are null are not used;
repeated labels of a row count each. With no labelled rows, one class only, or no words in one class of the texts that
train, every score is the share of toxic labels (0 without labels). Where few texts train, most subwords hardly move, and
texts without telling ones score alike. A score of just 0.5 is toxic. Repeated rows score alike; a very long text is
averaged whole, in a batch of its own. An empty table gives an empty result. Extra columns pass through; where one has
the name of the new column, the new one takes an underscore in front (`free_name`). Labels, language, source and ids
never enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import bounded_batches, free_name, table

SMALLEST, LARGEST = 3, 6
BITS = 18
SAMPLE = 8_000
#: Occurrences at the mean share that are added to a subword's own before its odds are taken.
STEADY = 5.0
_OPEN, _CLOSE = ord("<"), ord(">")


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's subwords, and n + 1 offsets of the words in them."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    b = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    return _subwords(b, at)


def _subwords(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(at)
    starts, owners, stops = [at[:-1]], [np.arange(len(lengths))], [at[1:]]
    for n in range(SMALLEST, LARGEST + 1):
        count = np.maximum(lengths - n + 1 - (lengths == n), 0)
        word = np.repeat(np.arange(len(lengths)), count)
        k = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        starts.append(at[word] + k)
        owners.append(word)
        stops.append(starts[-1] + n)
    start, owner, stop = map(np.concatenate, (starts, owners, stops))
    order = np.argsort(owner, kind="stable")
    start, stop = start[order], stop[order]
    first = np.searchsorted(owner[order], np.arange(len(lengths) + 1))
    h = tk.hash_spans(b, start, stop)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), first


@dataclass
class Model:
    """weight: of each bucket for the toxic class against the other; bias likewise."""

    weight: np.ndarray
    bias: float

    def words(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        buckets, first = _subwords(b, at)
        if not len(first) - 1:
            return np.empty(0)
        return np.add.reduceat(self.weight[buckets].astype(np.float64), first[:-1]) / np.diff(first)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = tk.words_of(data, offsets, tk.NOT_ALNUM, fold=True)
        n = np.diff(words.first)
        logit = np.full(len(n), self.bias)
        if len(words.start):
            _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
            b, ends = _marked(tk.LOWER[data[offsets[0] : offsets[-1]]], words.start[at], words.end[at])
            each = self.words(b, ends)[which]
            some = n > 0
            logit[some] += np.add.reduceat(each, words.first[:-1][some]) / n[some]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _marked(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of b, each between marks, and their offsets."""
    n = end - start
    at = np.concatenate(([0], np.cumsum(n + 2)))
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]], out[at[1:] - 1] = _OPEN, _CLOSE
    inner = np.repeat(at[:-1] + 1 - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    out[inner] = b[np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    return out, at


def _sparse(rows):
    """The vocabulary, and for every distinct word of every text its number, its share of the text, and the text."""
    index: dict[bytes, int] = {}
    word, share, size = [], [], []
    for words, counts, _ in rows:
        word.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
        c = np.asarray(counts, np.float32)
        share.append(c / max(1.0, float(c.sum())))
        size.append(len(words))
    return list(index), np.concatenate(word), np.concatenate(share), np.repeat(np.arange(len(rows), dtype=np.int32), size)


def _spread(vocabulary: list[bytes], run: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, word by word, and each word's number of them; made in runs of words."""
    buckets, n_sub = [], []
    for lo in range(0, len(vocabulary), run):
        got, first = subwords(vocabulary[lo : lo + run])
        buckets.append(got.astype(np.int32))
        n_sub.append(np.diff(first))
    return np.concatenate(buckets), np.concatenate(n_sub)


def _paces(times: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """How fast each subword is trained: by the square of its log-odds times their deviations, over the deviation of its share of a text.

    times: for both classes the texts' words that hold it. Both classes are compared with the mean share, with STEADY
    occurrences of that share added, so that a rare subword moves little and the balance of the classes cancels out.
    """
    toxic = times[1].sum() / times.sum()
    odds = np.log((times[1] + STEADY * toxic) / toxic) - np.log((times[0] + STEADY * (1 - toxic)) / (1 - toxic))
    off = (times[1] - times.sum(0) * toxic) / np.sqrt((times.sum(0) + 1) * toxic * (1 - toxic))
    pace = np.square(odds * off) / np.sqrt(spread)
    return pace / max(pace.max(), 1e-300)


class _Texts:
    """Texts as shares of words and words as means of subwords: the linear map from a number for each subword to one for each text, and back."""

    def __init__(self, rows):
        self.vocabulary, self.word, self.share, self.row = _sparse(rows)
        self.n, self.n_words = len(rows), len(self.vocabulary)

    def deal(self) -> None:
        """Numbers the subwords that occur; `used` are their buckets."""
        buckets, self.n_sub = _spread(self.vocabulary)
        self.vocabulary = None
        self.used = np.flatnonzero(np.bincount(buckets, minlength=1 << BITS))
        place = np.zeros(1 << BITS, np.int32)
        place[self.used] = np.arange(len(self.used))
        self.bucket = np.take(place, buckets, out=buckets)
        self.scale, self.at = 1 / self.n_sub, np.concatenate(([0], np.cumsum(self.n_sub)))

    def _runs(self, size: int = 50_000) -> Iterator[tuple[slice, np.ndarray]]:
        """Words, and their subwords' numbers, in runs that keep the arrays made of them small."""
        for lo in range(0, self.n_words, size):
            own = slice(lo, min(lo + size, self.n_words))
            yield own, self.bucket[self.at[own.start] : self.at[own.stop]].astype(np.intp)

    def onto(self, of_word: np.ndarray) -> np.ndarray:
        """For each subword the sum of a number over the words that hold it."""
        out = np.zeros(len(self.used))
        for own, bucket in self._runs():
            out += np.bincount(bucket, np.repeat(of_word[own], self.n_sub[own]), len(self.used))
        return out

    def forward(self, weight: np.ndarray) -> np.ndarray:
        words = np.concatenate([np.add.reduceat(weight[bucket], self.at[own] - self.at[own.start]) for own, bucket in self._runs()]) * self.scale
        return np.bincount(self.row, words[self.word] * self.share, self.n)

    def back(self, of_text: np.ndarray) -> np.ndarray:
        return self.onto(np.bincount(self.word, of_text[self.row] * self.share, self.n_words) * self.scale)


def _probability(texts: _Texts, params: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The softmax layer's share of the toxic class; of two classes only the difference matters."""
    table_, layer, bias = params
    z = texts.forward(table_ @ (layer[:, 1] - layer[:, 0])) + bias[1] - bias[0]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _gradients(texts: _Texts, params: tuple[np.ndarray, np.ndarray, np.ndarray], error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the summed log-loss by embeddings, layer and bias; error: probability less label of each text that counts, else 0."""
    table_, layer, _ = params
    each = texts.back(error)
    return each[:, None] * (layer[:, 1] - layer[:, 0]), np.outer(each @ table_, (-1, 1)), error.sum() * np.array([-1, 1])


def fit(rows, dim: int = 2, rounds: int = 300, rate: float = 1.0, patience: int = 40, seed: int = 7) -> Model:
    """rows, read more than once: distinct words, their counts and the label of each text.

    All subwords are trained. Every fifth text is held back to stop training; steps are scaled by the largest gradient of
    a parameter group, so that subwords gain by their pace and how much and how steadily they tell the classes apart.
    """
    y = np.array([r[2] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))) if len(y) else -50.0)
    texts = _Texts(rows)
    prior = Model(np.zeros(1 << BITS, np.float32), float(np.log(y.mean() / (1 - y.mean()))))
    held = np.arange(len(rows)) % 5 == 0
    seen = [np.bincount(texts.word[~held[texts.row] & (y[texts.row] == c)], minlength=texts.n_words) for c in (0, 1)]
    if not (seen[0].any() and seen[1].any()):  # the texts that train have words in one class only
        return prior
    texts.deal()
    spread = texts.onto(np.bincount(texts.word, np.square(texts.share, dtype=np.float64), texts.n_words) * texts.scale**2)
    pace = _paces(np.stack([texts.onto(c) for c in seen]), spread)[:, None]
    rng = np.random.default_rng(seed)
    params = (rng.random((len(texts.used), dim)) - 0.5) / dim * np.sqrt(pace), rng.normal(0, 1, (dim, 2)), np.log(np.array([1 - y.mean(), y.mean()]))
    speed = [np.zeros_like(p) for p in params]
    best, best_at, kept = np.inf, 0, params
    for t in range(rounds):
        p = _probability(texts, params)
        loss = -np.log(np.where(y == 1, p, 1 - p)[held] + 1e-9).mean()
        if loss < best:
            best, best_at, kept = loss, t, tuple(p.copy() for p in params)
        elif t - best_at > patience:
            break
        grads = _gradients(texts, params, np.where(held, 0, p - y))
        for k, (param, grad) in enumerate(zip(params, (grads[0] * pace, *grads[1:]), strict=True)):
            speed[k] = 0.8 * speed[k] + 0.2 * grad / (np.abs(grad).max() + 1e-12)
            param -= rate * (1, 0.1, 0.02)[k] * speed[k]
    table_, layer, bias = kept
    weight = np.zeros(1 << BITS, np.float32)
    weight[texts.used] = table_ @ (layer[:, 1] - layer[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


_SPACED = bytes(32 if tk.NOT_ALNUM[x] and not 65 <= x <= 90 else int(tk.LOWER[x]) for x in range(256))


def bag(text: str | None) -> Counter:
    """Distinct words and their counts."""
    return Counter((text or "").encode().translate(_SPACED).split())


@F.arrow_udf(T.StructType([T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())]))
def _bags(texts: pa.Array) -> pa.Array:
    bags = [bag(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([b" ".join(b) for b in bags], pa.binary()), pa.array([np.array(list(b.values()), "<i4").tobytes() for b in bags], pa.binary())], names=["words", "counts"])


class _Bags:
    """Rows of an Arrow table of bags, split only while they are read."""

    def __init__(self, got: pa.Table):
        self.got = got

    def __len__(self) -> int:
        return self.got.num_rows

    def __iter__(self):
        for batch in self.got.to_batches():
            for w, c, y in zip(batch["words"], batch["counts"], batch["y"], strict=True):
                yield w.as_py().split(), np.frombuffer(c.as_py(), "<i4"), y.as_py()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, **options) -> Model:
    """Fits a model to about `sample` of the labelled rows."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    if (n := known.count()) > sample:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    got = rows.select("id", "y", _bags.asNondeterministic()("text").alias("b")).select("id", "y", "b.*").toArrow().sort_by([("id", "ascending"), ("y", "ascending"), ("words", "ascending")])
    return fit(_Bags(got), **options)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Appends the toxic class's probability of each text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        data, offsets = tk.column_bytes(texts)
        own = Model(*shared.value)
        parts = [own.score(data, offsets[lo : hi + 1]) for lo, hi in tk.groups(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return docs.select("*", scores.asNondeterministic()(F.col(text)).alias(free_name(docs, out)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that are not held out."""
    return train(docs, labels.where(~held_out()))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with the columns of docs."""
    name = free_name(docs, "toxicity")
    return score(docs, learned(docs, labels), out=name).where(F.col(name) < 0.5).drop(name)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
