"""Quality rules as a bitmask ledger.

`measure` reads every text once and appends the measurements. `ledger` evaluates every rule once on them
and stores the outcome as one bit per rule in `failures`; texts are not needed afterwards. Policies are
versioned sets of rules (masks), so `apply_policy` and `ablation` are bitwise operations over the ledger.

Defined results: a null or empty text has no words, no lines and no symbols, and so fails `few_words`.
Repeated rows are judged alike, each by itself; ties don't occur, as every text is judged on its own. A very long
text is measured whole, in a batch of its own. Other columns pass through unread. Where the input has a column of
the name of a measurement or of the mask, the new one takes an underscore in front of its name (more, if that
is taken too), and `ledger` takes the `names` that `measured_names` gives. An empty table gives an empty ledger and
an ablation of zero counts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import bounded_batches, free_name

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 3
_SYMBOL = tk.separators("#*$%&|<>")
_NEWLINE = tk.separators("\n")


def _measured(col: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = tk.column_bytes(col)
    parts = {k: [] for k in MEASURES}
    for lo, hi in tk.groups(offsets):
        own = offsets[lo : hi + 1]
        words = tk.words_of(data, own, tk.SPACES)
        b = data[own[0] : own[-1]]
        # code points: bytes that don't continue a character
        heads = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[b])))
        lines = tk.words_of(data, own, _NEWLINE)
        filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
        n_lines = np.bincount(lines.row[filled], minlength=hi - lo)
        n_dup_lines, covered = _repeated(words, lines, filled, hi - lo)
        edge = own - own[0]
        parts["n_words"].append(np.diff(words.first))
        parts["word_chars"].append(tk.sums(heads[words.end] - heads[words.start], words.first))
        parts["n_symbols"].append(symbols[edge[1:]] - symbols[edge[:-1]])
        parts["n_lines"].append(n_lines)
        parts["n_dup_lines"].append(n_dup_lines)
        parts["n_repeat_words"].append(tk.sums(covered, words.first))
    return {k: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for k, v in parts.items()}


def _repeated(words: tk.Words, lines: tk.Words, filled: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the lines that equal an earlier one, and for each word whether a window that holds it recurs.

    Equal hashes propose, bytes decide; where they disagree, the rows are counted again on their contents.
    """
    row_key = tk.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    at = np.flatnonzero(filled)
    _, first, which = np.unique((lines.hash ^ row_key[lines.row])[at], return_index=True, return_inverse=True)
    again = np.ones(len(at), bool)
    again[first] = False
    a, b = at[again], at[first[which[again]]]
    right = (lines.row[a] == lines.row[b]) & tk.same_spans(lines.data, lines.start[a], lines.end[a], lines.start[b], lines.end[b])
    n_dup_lines = np.bincount(lines.row[a], minlength=rows)

    where, h = tk.windows(words, WINDOW)
    _, first, which, times = np.unique(h ^ row_key[words.row[where]], return_index=True, return_inverse=True, return_counts=True)
    many = times[which] > 1
    c, d = where[many], where[first[which[many]]]
    same = words.row[c] == words.row[d]
    for k in range(WINDOW):
        same &= tk.same_spans(words.data, words.start[c + k], words.end[c + k], words.start[d + k], words.end[d + k])
    covered = np.zeros(len(words.start), np.int64)
    for k in range(WINDOW):
        covered[c + k] = 1
    for r in sorted({*lines.row[a[~right]].tolist(), *lines.row[b[~right]].tolist(), *words.row[c[~same]].tolist(), *words.row[d[~same]].tolist()}):
        own = np.flatnonzero(filled & (lines.row == r))
        n_dup_lines[r] = len(own) - len({lines.data[x:y].tobytes() for x, y in zip(lines.start[own], lines.end[own], strict=True)})
        lo, hi = words.first[r], words.first[r + 1]
        said = [words.data[x:y].tobytes() for x, y in zip(words.start[lo:hi], words.end[lo:hi], strict=True)]
        found = Counter(zip(*(said[k:] for k in range(WINDOW))))  # noqa: B905
        covered[lo:hi] = 0
        for k in range(len(said) - WINDOW + 1):
            if found[tuple(said[k : k + WINDOW])] > 1:
                covered[lo + k : lo + k + WINDOW] = 1
    return n_dup_lines, covered


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in MEASURES]))
def _measure(text: pa.Array) -> pa.Array:
    found = _measured(text)
    return pa.StructArray.from_arrays([pa.array(found[k]) for k in MEASURES], names=list(MEASURES))


def measured_names(docs: DataFrame) -> dict[str, str]:
    """The columns in which `measure` puts the measurements of docs."""
    return {k: free_name(docs, k) for k in MEASURES}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Appends the measurements of each text."""
    bounded_batches(docs.sparkSession)
    x, names = free_name(docs, "measured"), measured_names(docs)
    got = docs.select("*", _measure.asNondeterministic()(F.col(text)).alias(x))
    return got.select("*", *(F.col(f"{x}.{k}").alias(v) for k, v in names.items())).drop(x)


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds. Bits are never reused for other rules."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines > 2 and 2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule(5, "short", "n_words < 100"),
)
#: Versioned policies: the names of the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "standard-1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "strict-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "short"),
}


def mask_of(policy: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in policies[policy])


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "failures", names: dict[str, str] | None = None) -> DataFrame:
    """Appends the bitmask of failed rules. names: the measurements' columns, if they aren't called as the rules do."""
    bits = [F.when(F.expr(_renamed(r.fails, names or {})), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in rules]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn(free_name(measured, name), mask)


def passes(policy: str, failures: str | Column = "failures", **parts) -> Column:
    col = F.col(failures) if isinstance(failures, str) else failures
    return col.bitwiseAND(F.lit(mask_of(policy, **parts)).cast("bigint")) == 0


def apply_policy(docs: DataFrame, policy: str = "standard-1", text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    measured = measure(docs, text)
    got = ledger(measured, names=measured_names(docs)).where(passes(policy, free_name(measured, "failures")))
    return got.select(*(F.col(f"`{c}`") for c in docs.columns))


def _renamed(condition: str, names: dict[str, str]) -> str:
    return re.sub(r"\b\w+\b", lambda m: f"`{names[m[0]]}`" if m[0] in names else m[0], condition)


def ablation(judged: DataFrame, policy: str = "standard-1", failures: str = "failures") -> DataFrame:
    """For each rule of the policy: rows failing it, rows that it alone rejects, rows kept without it.

    Rows are first counted by mask, at most 2 ** rules groups, so the rest runs on a handful of rows.
    """
    mask = mask_of(policy)
    own = [r for r in RULES if mask >> r.bit & 1]
    counts = judged.groupBy(F.col(failures).bitwiseAND(F.lit(mask).cast("bigint")).alias("m")).agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{k}{r.bit}") for r in own for k, c in (("fails_", F.col("m").bitwiseAND(1 << r.bit) != 0), ("only_", F.col("m") == 1 << r.bit), ("without_", F.col("m").bitwiseAND(mask & ~(1 << r.bit)) == 0))]
    row = counts.agg(*sums)
    each = [F.struct(F.lit(r.name).alias("rule"), *(F.coalesce(F.col(f"{k}{r.bit}"), F.lit(0)).cast("bigint").alias(out) for k, out in (("fails_", "n_failed"), ("only_", "n_only"), ("without_", "n_kept_without")))) for r in own]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = ledger(measure(docs).drop("text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base-1")).alias("base_failed"), passes("standard-1").alias("kept"), "n_lines", "failures")


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return ablation(ledger(measure(docs).drop("text")))


_JUDGED = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), pos as (
  select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3
), win as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from pos
), again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1
), covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id
), m as (
  select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines
  from w left join covered using (doc_id)
), judged as (
  select *, ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
    + 8 * (n_lines > 2 and 2 * n_dup_lines > n_lines)::bigint
    + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words))::bigint + 32 * (n_words < 100)::bigint)::bigint as failures
  from m
)"""
QUERIES = {"op4_quality_rules": op4_quality_rules, "quality_ablation": quality_ablation}
ORACLE_SQL = {
    "op4_quality_rules": _JUDGED + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) != 0 as base_failed, (failures & 15) = 0 as kept, n_lines, failures from judged""",
    "quality_ablation": _JUDGED + """
select rule, count(*) filter ((failures & bit) != 0)::bigint as n_failed, count(*) filter ((failures & 15) = bit)::bigint as n_only,
  count(*) filter ((failures & 15 & ~bit) = 0)::bigint as n_kept_without
from judged, (values ('few_words', 1::bigint), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8)) r(rule, bit) group by rule, bit""",
}
