import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import bpe, toxicity

SF = "/root/testdata/sf0.01"
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = ["toxicity", "quality rules", "near-duplicates", "benchmark decontamination", "byte-level BPE"]
ODD = [(9_000_001, None), (9_000_002, ""), (9_000_003, " \n"), (None, "no id " * 40), (9_000_004, " ".join(f"long{i}" for i in range(20_000)))]


@pytest.fixture(scope="module")
def docs(spark):
    """All documents, odd ones, a row twice, and columns whose names the stages use themselves."""
    own = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string")
    rows = own.unionByName(odd, allowMissingColumns=True).unionByName(own.where("doc_id = 1"))
    return rows.withColumns({c: F.lit(c) for c in ("toxicity", "contamination", "n_words", "failures", "ids", "digests", "id", "row")})


def few_words(text):
    words = WORD.findall(text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    signs = sum(c in "#*$%&|<>" for c in text or "")
    return len(words) < 50 or 100 * len(covered) > 50 * len(words) or 10 * signs > len(words) or (len(lines) > 2 and 2 * (len(lines) - len(set(lines))) > len(lines))


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def copies(rows):
    """Ids of documents that a smaller id is linked to, by way of others or not."""
    sets, root, holders = [shingles(t) for _, t in rows], list(range(len(rows))), {}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders.get(s, ()))
        for j, both in shared.items():
            if 100 * both >= 75 * (len(own) + len(sets[j]) - both):
                p, q = sorted((find(j), find(k)))
                root[q] = p
        for s in own:
            holders.setdefault(s, []).append(k)
    return {rows[k][0] for k in range(len(rows)) if find(k) != k}


def windows_of(items):
    found = set()
    for _, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        found |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    return found


def contaminated(text, windows):
    words, hit = ALNUM.findall((text or "").translate(LOWER)), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_against_brute_force(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    def run(name, now):
        got = stages[name](spark, now, SF)
        assert got.columns == docs.columns
        return spark.createDataFrame(got.collect(), got.schema)

    first = rows(docs)
    model = toxicity.learned(docs, labels)
    raw = [(t or "").encode() for _, t in first]
    score = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    now = run("toxicity", docs)
    assert Counter(rows(now)) == Counter(d for d, s in zip(first, score, strict=True) if s < 0.5)
    assert 0 < docs.count() - now.count() < 0.2 * docs.count()

    kept = rows(now)
    now = run("quality rules", now)
    assert Counter(rows(now)) == Counter(d for d in kept if not few_words(d[1]))

    kept = sorted((d for d in set(rows(now)) if d[0] is not None), key=lambda d: d[0])
    unnamed = [d for d in rows(now) if d[0] is None]
    now = run("near-duplicates", now)
    gone = copies(kept)
    assert Counter(rows(now)) == Counter([d for d in kept if d[0] not in gone] + unnamed) and gone

    kept = rows(now)
    windows = windows_of(rows(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")))
    now = run("benchmark decontamination", now)
    assert Counter(rows(now)) == Counter(d for d in kept if not contaminated(d[1], windows))

    kept = dict(rows(now))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})
    got = stages["byte-level BPE"](spark, now, SF).collect()
    assert len(got) == len(kept)
    for r in got:
        ids = want.encode_ordinary(kept[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_run_is_its_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == now.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, now.collect()))


def test_stages_of_an_empty_table(spark, docs):
    none = docs.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).isEmpty()
