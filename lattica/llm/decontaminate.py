"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised (A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) and cut into windows
of 13 consecutive words; an item of fewer words is one window. The automaton's alphabet is the benchmark's
vocabulary: each of its words is one code point, so a window is a string of at most 13 characters and every other
word of a document is the one character that no window holds. A document's code string is scanned once; as it has a
character for each word, match positions are word positions, which the word spans map back to offsets in the text.

Benchmarks are read in parts of at most `max_words` words, each an automaton that is built once in a Python worker, so
neither the driver nor a worker holds more of them. One part, as common benchmarks are, takes one pass. Of more
parts each takes a pass of its own, with the documents and what was found so far written to the shared folder between
them; hit words and items of all parts are united, so the result is that of one automaton. Items longer than a part
are cut into pieces that share all windows. Documents are never shuffled, so copies, hot sources and very long texts
cost what their bytes cost.

Defined results: null or empty texts and texts without words have no words, no hits and are not contaminated. Items
without words have no window; repeated items each count; an item without an id counts for hits and not for ids.
Windows that many items share belong to all of them. Repeated document rows are judged each by itself; a very long text
is scanned whole. An empty benchmark hits nothing, and an empty table gives an empty result. Extra columns pass through;
where one has the name of the new column, the new one takes an underscore in front (`free_name`).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk
from .shared import bounded_batches, free_name, remove_table, written

WINDOW = 13
#: Words of the benchmark in one automaton; it takes some 0.6 kB for each, and a code point for each distinct one.
MAX_WORDS = 500_000
#: Lower-cases A-Z and turns every byte that no word holds into a space.
_FOLD = bytes(32 if tk.NOT_ALNUM[x] and not 65 <= x <= 90 else int(tk.LOWER[x]) for x in range(256))
_OTHER = "\x00"
_FIRST, _SURROGATES = 0x100, range(0xD800, 0xE000)


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _code(k: int) -> str:
    k += _FIRST
    return chr(k if k < _SURROGATES.start else k + len(_SURROGATES))


class Automaton:
    """Windows of the items; built once in each Python worker from items' ids and words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.codes: dict[bytes, str] = {}
        owners: dict[str, set[str]] = defaultdict(set)
        for item, words in items:
            coded = "".join(self.codes.setdefault(w, _code(len(self.codes))) for w in words)
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                owners[coded[k : k + window]] |= set() if item is None else {item}
        self.owners = [frozenset(x) for x in owners.values()]
        self.tree = ahocorasick.Automaton()
        for k, w in enumerate(owners):
            self.tree.add_word(w, (k, len(w)))
        if owners:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged ranges of hit words, and which windows occur."""
        if not self.owners:
            return [], set()
        get, ranges, seen = self.codes.get, [], set()
        coded = "".join([get(w, _OTHER) for w in words])
        for last, (k, n) in self.tree.iter(coded):
            seen.add(k)
            lo = last + 1 - n
            while ranges and ranges[-1][1] >= lo:
                lo = min(lo, ranges.pop()[0])
            ranges.append((lo, last + 1))
        return ranges, seen


_built: dict[str, Automaton] = {}


def _automaton(shared) -> Automaton:
    key, items, window = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def _offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets in the original text of ranges of words."""
    raw = text.encode()
    found = tk.words_of(np.frombuffer(raw.translate(_FOLD), np.uint8), np.array([0, len(raw)]), tk.SPACES)
    point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(point[found.start[a]]) - 1, "end": int(point[found.end[b - 1] - 1])} for a, b in ranges]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS), T.StructField("ranges", _SPANS)])


def parts_of(benchmark: DataFrame, item: str, text: str, window: int, max_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items' ids and words in parts of at most max_words (or a window) words, an item's pieces sharing window - 1 words."""
    most = max(max_words, window)
    part: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for own, raw in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        words = normalised(raw)
        while words:
            if size and most - size < min(len(words), window):
                yield part
                part, size = [], 0
            k = min(len(words), max(most - size, window))
            part.append((own, words[:k]))
            size += k
            words = words[k - window + 1 :] if k < len(words) else []
    if part:
        yield part


def _united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(a + b):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _pass(docs: DataFrame, items: list, window: int, text: str, earlier: str | None, out: str) -> DataFrame:
    key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, items, window))

    @F.arrow_udf(_RESULT)
    def judge(texts: pa.Array, before: pa.Array) -> pa.Array:
        tree, found = _automaton(shared), []
        for t, was in zip(texts, before, strict=True):
            t, was = t.as_py() or "", was.as_py()
            words = normalised(t)
            ranges, seen = tree.scan(words)
            ids = set().union(*(tree.owners[k] for k in seen)) if seen else set()
            if was:
                ranges = _united(ranges, [(x["start"], x["end"]) for x in was["ranges"]])
                ids |= set(was["items"])
            listed = [{"start": lo, "end": hi} for lo, hi in ranges]
            found.append({"n_words": len(words), "n_hit": sum(b - a for a, b in ranges), "items": sorted(ids), "spans": _offsets(t, ranges) if ranges else [], "ranges": listed})
        return pa.array(found, type=to_arrow_type(_RESULT))

    before = F.lit(None).cast(_RESULT) if earlier is None else F.col(earlier)
    return docs.select("*", judge.asNondeterministic()(F.col(text), before).alias(out))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS, out: str = "contamination") -> DataFrame:
    """Appends, as out: n_words, n_hit, the sorted ids of items that occur, and the hits as spans of the text and ranges of words."""
    bounded_batches(docs.sparkSession)
    parts = parts_of(benchmark, item, item_text, window, max_words)
    name, other = free_name(docs, out), free_name(docs, f"{out}_before")
    got = _pass(docs, next(parts, []), window, text, None, name)
    last = None
    for part in parts:
        own = written(got.withColumnRenamed(name, other), "contamination")
        got = _pass(own, part, window, text, other, name).drop(other)
        if last is not None:
            remove_table(last)
        last = own
    return got


def contaminated(result: str = "contamination"):
    """A twentieth of the words, and one at least, lie in windows of the benchmark."""
    return (F.col(f"{result}.n_hit") > 0) & (20 * F.col(f"{result}.n_hit") >= F.col(f"{result}.n_words"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = "contamination"
    return got.select("doc_id", F.col(f"{c}.n_words").alias("n_words"), F.col(f"{c}.n_hit").alias("n_hit"), F.size(f"{c}.items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op3_decontaminate": f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
win as (select distinct item_id, least(13, len(ws)) as n, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') as g
  from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct n from win),
dw as (select doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') as g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n)),
hits as (select dw.doc_id, dw.n, dw.i, win.item_id from dw join win on dw.n = win.n and dw.g = win.g),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)""",
}
