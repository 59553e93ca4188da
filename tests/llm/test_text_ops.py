"""Edge cases of every operator: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import textkit as tk
from lattica.llm import bpe, chat, decontaminate, minhash, quality, token_counts, token_files, toxicity, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven old wizards drink warm tea near a quiet river bank".split()
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Tab\tand\x0bspace  twice \n\n",
    "é中 😀 naïve œuvre",
    " ".join(PROSE),
    " ".join(PROSE).upper(),
    " ".join(PROSE),
    " ".join(PROSE * 40) + " end",
    "it's 42%%% of $9.99 & <b>|#1*</b>",
    "x" * 70_000,
    " ".join(f"w{i}" for i in range(30_000)),
    "a\x1cb\x85c\u00a0d\u3000e",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, "n") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6]], "doc_id bigint, text string, score string, n_words int, contamination string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_measures(docs, none):
    got = by_id(quality.ledger(quality.measure(docs.select("doc_id", "text")).drop("text")))
    for i, t in enumerate(TEXTS):
        words = WORD.findall(t or "")
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + d for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)), i
    clashing = quality.measure(docs)
    assert clashing.columns == [*docs.columns, "_n_words", *quality.MEASURES[1:]] and {r.n_words for r in clashing.collect()} == {1}
    assert quality.ledger(clashing, names=quality.measured_names(docs)).where("failures & 1 = 0 and _n_words < 50").isEmpty()
    kept = quality.apply_policy(docs, "standard-1")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {12}
    assert quality.ledger(quality.measure(none.select("doc_id", "text"))).count() == 0
    judged = quality.ledger(quality.measure(docs.select("text")))
    table = {r.rule: r for r in quality.ablation(judged).collect()}
    assert table["few_words"].n_failed == judged.where("n_words < 50").count()
    assert table["few_words"].n_kept_without == judged.where("failures & 14 = 0").count()


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_texts_are_told_apart(spark, n):
    """Texts of this kind are equal under polynomial hashes modulo a power of two, whatever their base."""
    a, b = thue_morse(n)
    lines = f"{a}\n{b}\n{a}"
    words = f"{a} x y {b} x y {a} x z"
    five = " ".join([a, *PROSE[:4]]), " ".join([b, *PROSE[:4]])
    docs = spark.createDataFrame([(1, lines), (2, words), (3, a), (4, b), (5, f"{a} {b}"), (6, f"{b} {a}"), (7, five[0]), (8, five[1])], "doc_id bigint, text string")
    got = by_id(quality.measure(docs))
    assert (got[1].n_dup_lines, got[2].n_repeat_words) == (1, 0)
    near = by_id(minhash.near_duplicates(docs))
    assert {k: r.component_id for k, r in near.items()} == {k: k for k in range(1, 9)}


def test_equal_hashes_of_different_spans_are_found_out(monkeypatch):
    texts = [t for t in TEXTS if t is None or len(t) < 5000] + ["a\nb\na\nc", "p q r p q r s", "p q r s p q t"]
    plain = quality._measured(pa.array(texts, pa.string()))
    data, offsets = tk.column_bytes(pa.array(["wonderful wonderous wonderful", "wonderous"]))
    monkeypatch.setattr(tk, "hash_spans", lambda b, starts, ends: np.zeros(len(starts), np.uint64))
    clashing = quality._measured(pa.array(texts, pa.string()))
    assert all((plain[k] == clashing[k]).all() for k in quality.MEASURES)
    d = tk.digests(tk.words_of(data, offsets, tk.SPACES)).tolist()
    assert d[0] == d[2] != d[1] == d[3]


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = " ".join(PROSE), " ".join(reversed(PROSE)), " ".join(PROSE[::2])
    rows = [(3, a), (7, a), (7, b), (9, b), (12, c), (12, ""), (14, c), (20, None), (20, "alone"), (5, c)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 5, True), (7, 3, False), (7, 3, False), (9, 3, False), (12, 5, False), (12, 5, False), (14, 5, False), (20, 20, True), (20, 20, True)]


def test_contamination(spark, docs, none):
    items = [(1, " ".join(PROSE[:14])), (2, "Lazy, dog!"), (3, None), (4, "..."), (None, "seven old wizards"), (2, "Lazy, dog!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.scan(docs, bench, out="found").withColumn("bad", decontaminate.contaminated("found")))
    windows = []
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        windows += [(item, w[k : k + 13]) for k in range(max(1, len(w) - 12))] if w else []
    for i, t in enumerate(TEXTS):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        hit, found = set(), set()
        for item, w in windows:
            if len(ws) > 5000:
                break
            for k in range(len(ws) - len(w) + 1):
                if ws[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found |= {str(item)} - {"None"}
        r = got[i]
        assert (r.found.n_words, r.found.n_hit, list(r.found["items"])) == (len(ws), len(hit), sorted(found)), i
        assert r.bad == (len(hit) > 0 and 20 * len(hit) >= len(ws))
    spans = got[7].found.spans
    assert TEXTS[7][spans[0].start : spans[0].end].lower().startswith("the quick")
    assert decontaminate.scan(docs, bench.where("1 = 0"), out="found").where("found.n_hit > 0").isEmpty()
    assert decontaminate.scan(none, bench, out="found").isEmpty()
    # parts of any size, items cut into pieces, and a clashing column give the result of one automaton
    whole = [tuple(r) for r in decontaminate.scan(docs, bench, out="found").select("doc_id", "found.*").orderBy("doc_id").collect()]
    for most in (13, 15):
        parted = decontaminate.scan(docs, bench, max_words=most)
        assert parted.columns == [*docs.columns, "_contamination"]
        assert [tuple(r) for r in parted.select("doc_id", "_contamination.*").orderBy("doc_id").collect()] == whole


def test_parts_of_a_benchmark_share_all_windows(spark):
    items = [(k, " ".join(f"v{k % 3}x{i}" for i in range(n))) for k, n in enumerate([40, 5, 13, 14, 0, 100, 12])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    cut = lambda ws: {tuple(ws[k : k + 13]) for k in range(max(1, len(ws) - 12))} if ws else set()
    want = {str(k): cut(decontaminate.normalised(t)) for k, t in items if t}
    for most in (1, 13, 20, 57, 1000):
        got: dict = {}
        for part in decontaminate.parts_of(bench, "item_id", "text", 13, most):
            assert sum(len(ws) for _, ws in part) <= max(most, 13)
            for k, ws in part:
                got.setdefault(k, set()).update(cut(ws))
        assert got == want, most


def test_more_distinct_words_than_one_automaton_takes(spark):
    decontaminate._code(decontaminate.MAX_WORDS)  # a code point for each word, even if all are distinct
    n = 3000
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(n))), (2, "alpha beta")], "item_id int, text string")
    said = " ".join(f"q{i}" for i in range(n - 13, n)), " ".join(f"q{i}" for i in range(13)) + " alpha beta", " ".join(f"q{i}" for i in range(7, 19))
    got = decontaminate.scan(spark.createDataFrame(list(enumerate(said)), "doc_id int, text string"), bench, max_words=1000).orderBy("doc_id").collect()
    assert [(r.contamination.n_hit, r.contamination["items"]) for r in got] == [(13, ["1"]), (15, ["1", "2"]), (0, [])]


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    smallest = {}
    for k in range(len(rows)):
        smallest[find(k)] = min(smallest.get(find(k), rows[k][0]), rows[k][0])
    return {(rows[k][0], len(sets[k])): smallest[find(k)] for k in range(len(rows))}


def test_near_duplicates_by_brute_force(spark, docs, none):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(60)]
    rows = [(100 + k, TEXTS[k]) for k in range(len(TEXTS))]
    for k in range(60):  # a group of near copies around one text, some of them just below the bound to others
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            w[at] = f"new{k}-{at}"
        rows.append((1000 + int(rng.permutation(500)[0]) * 60 + k, " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(90_000 + k, shared + " " + " ".join(f"u{k}-{i}" for i in range(int(rng.integers(5, 60))))) for k in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    want = components_of(rows)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    assert minhash.near_duplicates(none).isEmpty()
    kept = minhash.distinct_documents(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))))
    ids = [r.doc_id for r in kept.collect()]
    first = sorted({i for (i, _), c in components_of(list(enumerate(TEXTS))).items() if i == c})
    assert kept.columns == docs.columns and ids.count(None) == 1 and sorted(i for i in ids if i is not None) == first


def test_large_buckets_are_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(50):
        w = [f"v{i}" for i in range(40)]
        for at in rng.choice(40, rng.integers(0, 3), replace=False):
            w[at] = f"n{k}-{at}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == components_of(rows)


def test_estimate_follows_similarity():
    a = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        n = int(4000 * share)
        b = np.concatenate((a[:n], np.random.default_rng(2).integers(0, 1 << 63, 4000 - n, dtype=np.uint64)))
        m = minhash.minima(np.concatenate((a, b)), np.array([0, 4000, 8000]))
        p = minhash.packed(m)
        d = p[0] ^ p[1]
        d |= d >> np.uint64(2)
        d |= d >> np.uint64(1)
        equal = minhash.K - int(np.bitwise_count(d & minhash._LOW).sum())
        estimate = (equal / minhash.K - minhash._CHANCE) / (1 - minhash._CHANCE)
        assert abs(estimate - n / (8000 - n)) < 0.2


def test_bpe_as_tiktoken(docs, none):
    ranks = bpe.read_ranks(bpe.vocabulary())
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.decode(bpe.encode(docs.select("doc_id", "text"))))
    digest = by_id(bpe.digests(docs.select("doc_id", "text")).select("doc_id", "digests.*"))
    for i, t in enumerate(TEXTS):
        ids = want.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and bytes(got[i].decoded) == (t or "").encode(), i
        assert digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(none).isEmpty()


def test_bpe_on_every_kind_of_character():
    codec = bpe.Codec(bpe.read_ranks(bpe.vocabulary()))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0xF900, 0x10000, 17)) + list(range(0x10000, 0x20000, 97))
    texts = [f"a{chr(c)} {chr(c)}b  {chr(c)} 's{chr(c)}1{chr(c)}\n{chr(c)}" for c in points]
    assert [x.tolist() for x in codec.encode_batch(pa.array(texts))] == [want.encode_ordinary(t) for t in texts]


def test_token_files_round_trip(spark, docs, none, tmp_path, monkeypatch):
    tok = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    tok.encode_special_tokens = True
    special = docs.limit(1).withColumns({"doc_id": F.lit(50).cast("bigint"), "text": F.lit("a <|endoftext|> b")})
    unnamed = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit("no id")})
    folder = f"file://{tmp_path}/out"
    token_files.write(docs.unionByName(special).unionByName(unnamed), folder)
    got = sorted(token_files.read(spark, folder, crc=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([*range(len(TEXTS)), 6]), 50]
    start = 0
    for r in got:
        t = "no id" if r.doc_id is None else "a <|endoftext|> b" if r.doc_id == 50 else TEXTS[r.doc_id] or ""
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    # by slices, as from a store that can't be mapped, in batches of few ids
    monkeypatch.setattr(token_files, "BATCH_IDS", 50)
    with open(f"{tmp_path}/out/manifest.json") as f:
        shard = json.load(f)["shards"][0]
    place, at = token_files._place(f"{folder}/{shard['name']}.ids")
    remote, local = token_files._Remote(place, at, "<u2"), token_files.mapped(place, at, "<u2")
    n = shard["n_ids"]
    assert remote[0:n].tolist() == local[0:n].tolist() and remote[1:3].tolist() == local[1:3].tolist() and remote[2:2].tolist() == []
    again = sorted(token_files.read(spark, folder, crc=True).collect(), key=lambda r: r.start)
    assert again == got
    token_files.write(none, f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").isEmpty()


def test_counts_after_edits(spark, docs, none):
    shared = open(public_tokenizers.path(token_counts.VOCABULARY), "rb").read()
    counter = token_counts.Counter(shared)
    rng, parts = np.random.default_rng(3), ["a", "b", " ", "  ", "\n", "'", "'re", "1", "é", ".", "word", " the", "中"]
    draw = lambda n: "".join(rng.choice(parts, n))
    for k in range(300):
        text = draw(int(rng.integers(0, 800 if k % 10 == 0 else 30)))
        tree = token_counts.Tree.of(text, counter)
        for _ in range(6):
            pos, cut, ins = int(rng.integers(-1, len(text) + 3)), int(rng.choice([0, 1, 3, 40])), draw(int(rng.choice([0, 1, 4, 90])))
            tree.edit(pos, cut, ins, counter)
            at = min(max(pos, 0), len(text))
            text = text[:at] + ins + text[at + min(cut, len(text) - at) :]
            assert tree.text == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text))
            assert tree.leaves() == token_counts.Tree.of(text, counter).leaves()
    rows = docs.select("doc_id", "text").withColumn("edits", F.when(F.col("doc_id") != 3, token_counts.planned_edits()))
    once = by_id(token_counts.counts(rows))
    kept = by_id(token_counts.apply_edits(token_counts.trees(rows)))
    for i, t in enumerate(TEXTS):
        assert once[i].counts.n_before == len(counter.encoding.encode_ordinary(t or ""))
        assert once[i].counts.n_after == kept[i].edited.n_tokens == len(counter.encoding.encode_ordinary(kept[i].edited.text))
    assert once[3].counts.n_encoded == 0 and once[12].counts.n_encoded < 60
    assert token_counts.trees(none).isEmpty()


def test_toxicity_learns_and_shares_subwords(spark, none):
    rng = np.random.default_rng(1)
    mild = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(mild, 60))
        if i % 4 == 0:
            w[5], w[30] = rng.choice(["hateful", "despicable"], 2)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learned(docs, lab)
    got = toxicity.score(docs.withColumn("held", toxicity.held_out()), model, out="p").join(lab, "doc_id").where("held and toxic is not null")
    right = got.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("toxic")).cast("double"))).first()[0]
    assert right > 0.97
    new = spark.createDataFrame([(0, "hatefull despicabel " + " ".join(mild[:40])), (1, " ".join(mild[:42])), (2, None), (3, ""), (4, "!")], "doc_id bigint, text string")
    p = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert p[0] > 0.5 > p[1] and p[2] == p[3] == p[4] and 0 <= p[2] <= 1
    assert toxicity.reject_toxic(docs, lab).columns == docs.columns
    empty = toxicity.train(docs, lab.where("1 = 0"))
    assert toxicity.score(new, empty).where("score >= 0.5").isEmpty()
    assert toxicity.score(none.select("doc_id", "text"), model).isEmpty()


@pytest.mark.parametrize(("n", "every"), [(40, 2), (400, 2), (80, 8), (400, 3)])
def test_toxicity_learns_from_balanced_and_from_few_labels(n, every):
    rng = np.random.default_rng(3)
    mild = [f"word{k}" for k in range(300)]

    def texts(count):
        for i in range(count):
            w = list(rng.choice(mild, 60))
            if i % every == 1:
                w[5], w[30] = rng.choice(["hateful", "despicable"], 2)
            yield " ".join(w), int(i % every == 1)

    model = toxicity.fit([(list(b), list(b.values()), y) for t, y in texts(n) for b in [toxicity.bag(t)]])
    new = list(texts(200))
    data = [t.encode() for t, _ in new]
    p = model.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y = np.array([y for _, y in new])
    assert ((p >= 0.5) == y)[y == 1].mean() > 0.75 and ((p >= 0.5) == y)[y == 0].mean() > 0.95


def test_toxicity_sample_is_8000():
    assert toxicity.SAMPLE == 8_000


def test_url_rules_and_trees(spark):
    listed = ["http://a.EXAMPLE.com/en/7x?q#f", "https://example.com/en/8", "x://notexample.com/en/7", "https://com/en/", "ftp://q.net/de/1", "http://b.example.net/de/80", "http://org/es", "http://org/es/", None, "nourl", "http://", "http://h?x=1/en/", "http://h#a://b", "://u.com/en/9"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*listed, listed[0]])], "page_id int, url string, note string, x_mine string")
    got = {r.page_id: r for r in urls.matched(urls.parts(pages)).collect()}
    want = {0: ("a.example.com", "/en/7x", "example.com/en/7"), 1: ("example.com", "/en/8", "com/en/"), 2: ("notexample.com", "/en/7", "com/en/"), 3: ("com", "/en/", "com/en/"), 4: ("q.net", "/de/1", "net/de/"), 5: ("b.example.net", "/de/80", "example.net/de/8"), 6: ("org", "/es", None), 7: ("org", "/es/", "org/es/"), 8: ("", "", None), 9: ("", "", None), 10: ("", "", None), 11: ("h", "", None), 12: ("h", "", None), 13: ("u.com", "/en/9", "com/en/")}
    assert {k: (r.host, r.path, r.rule) for k, r in got.items() if k in want} == want
    train = spark.createDataFrame([(f"http://s{k}.bad{k % 3}.zz/{'x/' * (k % 5)}{k * 7919}?a={k}&b=1&c=2", 1) for k in range(120)] + [(f"https://www.good{k % 4}.yy/page/name{k % 9}", 0) for k in range(120)] + [("http://z.zz/", None)], "url string, label int")
    model = urls.fit(train)
    judged = urls.judge(train.where("label is not null"), model, rules=())
    assert judged.where("(score >= 0.5) != (label = 1)").count() <= 2
    again = urls.fit(train.repartition(7))
    assert model.trees == again.trees and len(model.trees) == urls.TREES
    assert urls.judge(pages, urls.fit(train.where("1 = 0"))).where("rule is null and verdict != 'allow'").isEmpty()
    assert urls.judge(pages, urls.fit(train.where("label = 1"))).where("rule is null and verdict != 'block'").isEmpty()
    assert urls.judge(pages.where("1 = 0"), model).isEmpty()
    clashing = pages.withColumns({"host": F.lit("mine"), "score": F.lit("own"), "rule_verdict": F.lit("r"), "tail1": F.lit("t")})
    got = urls.judge(clashing, model)
    assert got.columns == [*clashing.columns, "_host", "path", "rule", "_score", "verdict"]
    assert {(r.x_mine, r.host, r.score, r.rule_verdict, r.tail1) for r in got.collect()} == {("y", "mine", "own", "r", "t")}
    tie = urls.matched(urls.parts(pages.where("page_id = 0")), ("block com/en/7x", "allow com/en/7x", "block example.com/en/7"))
    assert [(r.rule, r.rule_verdict) for r in tie.collect()] == [("example.com/en/7", "block")]
    tie = urls.matched(urls.parts(pages.where("page_id = 0")), ("block com/en/7x", "allow com/en/7x"))
    assert [(r.rule, r.rule_verdict) for r in tie.collect()] == [("com/en/7x", "allow")]
    long = spark.createDataFrame([(1, "http://a.com/" + "x1/" * 200_000), (2, "http://" + "y" * 300_000)], "page_id int, url string")
    assert [len(r.path) for r in urls.judge(long, model).orderBy("page_id").collect()] == [600_001, 0]


def test_training_urls_are_distinct_and_bounded(spark):
    rows = [("http://hot.zz/", 1)] * 5000 + [(f"http://a{k}.zz/{k}", 0) for k in range(3000)] + [(f"http://b{k}.yy/", 1) for k in range(40)] + [("http://hot.zz/", 0)]
    got, totals, size = urls.training(spark.createDataFrame(rows, "url string, label int"), "url", "label", 400)
    assert totals == {0: (3001, 3001), 1: (41, 5040)} and size == 400
    kept = got.collect()
    assert 330 < len(kept) < 470 and sum(r.y for r in kept) == 41
    hot = next(r.w for r in kept if r.url == "http://hot.zz/" and r.y == 1)
    assert abs(hot / urls._FIXED - 5000 * 400 / 8041) < 1e-6
    whole, _, _ = urls.training(spark.createDataFrame(rows, "url string, label int"), "url", "label", 10_000)
    assert whole.count() == 3042 and round(whole.agg(F.sum("w")).first()[0] / urls._FIXED, 3) == 3042


def test_tree_levels_by_brute_force(spark):
    """One tree's splits and leaves against sums over the rows in plain Python."""
    rng = np.random.default_rng(6)
    rows = [(f"http://{'s' * int(rng.integers(1, 9))}.zz/{'p/' * int(rng.integers(0, 6))}{int(rng.integers(0, 99))}", int(rng.random() < 0.3)) for _ in range(300)]
    train = spark.createDataFrame(rows, "url string, label int")
    model = urls.fit(train)
    x = urls.featured(urls.parts(train), "x_").withColumnRenamed("label", "y")
    x = model.with_suffixes(x).select("y", *(F.col(f"x_{c}").alias(c) for c in [*urls.lexical(), *urls._TAILS])).toPandas()
    copies = Counter(rows)
    w = np.array([1 / copies[r] for r in rows]) * np.array([copies[r] for r in rows]) * len(copies) / len(rows)
    margin = np.full(len(rows), model.bias)

    def leaf_sums(tree, at):
        if not isinstance(tree, tuple):
            g, h = ((p - x.y.to_numpy()) * w)[at].sum(), (p * (1 - p) * w)[at].sum()
            assert abs(tree - -urls.RATE * g / (h + urls.LAMBDA)) < 1e-5
            margin[at] += tree
            return
        left = at & (x[tree[0]] <= tree[1]).to_numpy()
        leaf_sums(tree[2], left)
        leaf_sums(tree[3], at & ~left)

    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        leaf_sums(tree, np.ones(len(rows), bool))


def test_url_rules_as_in_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    columns = "page_id, host, path, rule, rule_verdict"
    want = sorted(db.execute(f"select {columns} from ({urls.ORACLE_SQL['url_rules']})").fetchall())
    assert sorted(map(tuple, urls.op1_rules(spark, folder).select(*columns.split(", ")).collect())) == want
    got = urls.op1_url_filter(spark, folder).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(tuple(r)[:4] for r in got) == [w[:4] for w in want]
    assert all(r.verdict == v for r, (*_, v) in zip(sorted(got), want, strict=True) if v) and {r.verdict for r in got} == {"allow", "block"}


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com/p/?utm_x=1", 100, {"etag": '"a"', "content-type": "t", "date": "d1"}, "x"),
        (2, "revisit", "https://a.com/p#f", 200, {"etag": 'W/"a"', "date": "d2", "content-type": "no"}, None),
        (3, "response", "http://a.com/p", 90_000, {"etag": '"b"'}, "y"),
        (4, "revisit", "http://a.com/p", 90_000, {"etag": '"a"'}, None),
        (5, "revisit", "http://a.com/p", 400_000, None, "y"),
        (6, "revisit", "http://a.com/p", 50, None, None),
        (7, "revisit", None, 50, None, None),
        (8, "revisit", "http://a.com/p", None, None, None),
        (9, "revisit", "http://a.com/p", 500_000, {}, "z"),
        (9, "revisit", "http://a.com/p", 500_000, {}, "z"),
    ]
    rec = spark.createDataFrame([(i, t, u, h, d, s, "extra") for i, t, u, s, h, d in rows], "record_id bigint, type string, uri string, headers map<string,string>, digest string, s bigint, slot string").withColumn("captured", F.timestamp_seconds("s"))
    got = warc.resolve(rec).collect()
    assert len(got) == 8
    by = {r.record_id: (r.outcome, r.source_id) for r in got}
    assert by == {2: ("resolved", 1), 4: ("changed", 3), 5: ("resolved", 3), 6: ("missing", None), 7: ("missing", None), 8: ("missing", None), 9: ("changed", 3)}
    merged = next(r.merged for r in got if r.record_id == 2)
    assert merged == {"etag": 'W/"a"', "content-type": "t", "date": "d2"}
    assert warc.resolve(rec.where("1 = 0")).isEmpty()
    clashing = rec.withColumns({"url": F.lit("mine"), "outcome": F.lit("own")})
    again = warc.resolve(clashing)
    assert again.columns == [*clashing.columns, "_url", "_outcome", "source_id", "merged"]
    assert {r.record_id: (r._outcome, r.source_id) for r in again.collect()} == by and {(r.url, r.outcome, r.slot) for r in again.collect()} == {("mine", "own", "extra")}


def test_revisits_by_status_profile_and_last_modified(spark):
    u = "http://a.com/p"
    rows = [
        (1, "response", 100, {"etag": '"a"'}, "x", 200, None),
        (2, "response", 200, {"etag": '"gone"'}, "z", 404, None),
        (3, "response", 250, {}, None, None, None),
        (4, "revisit", 300, {"etag": '"a"'}, None, 304, None),
        (5, "revisit", 400, {"last-modified": "m2", "etag": '"a"', "x": "own"}, "x", 200, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        (6, "revisit", 500, {}, None, 200, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        (7, "response", 600, {"last-modified": "m7"}, "y", 200, None),
        (8, "revisit", 700, {"last-modified": "m7"}, None, 304, None),
        (9, "revisit", 700, {"last-modified": "m8"}, None, 304, "http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
        (10, "revisit", 700, {"etag": '"q"'}, None, 304, None),
        (11, "metadata", 700, {}, None, None, None),
        (12, None, 700, {}, None, None, None),
    ]
    rec = spark.createDataFrame([(i, t, u, h, d, s, c, f) for i, t, s, h, d, c, f in rows], "record_id bigint, type string, uri string, headers map<string,string>, digest string, s bigint, status int, profile string").withColumn("captured", F.timestamp_seconds("s"))
    got = {r.record_id: r for r in warc.resolve(rec).collect()}
    assert {k: (r.outcome, r.source_id) for k, r in got.items()} == {4: ("resolved", 1), 5: ("resolved", 1), 6: ("changed", 1), 8: ("resolved", 7), 9: ("changed", 7), 10: ("resolved", 7)}
    assert got[5].merged == {"last-modified": "m2", "etag": '"a"', "x": "own"} and got[10].merged == {"last-modified": "m7", "etag": '"q"'}


def test_one_url_with_most_captures_by_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(k, "response" if rng.random() < 0.2 else "revisit", "http://hot/" if rng.random() < 0.7 else f"http://h/{rng.integers(0, 5)}" + "x" * 20_000, int(rng.integers(0, 50))) for k in range(800)]
    rec = spark.createDataFrame(rows, "record_id bigint, type string, uri string, s bigint").selectExpr("*", "timestamp_seconds(s) as captured", "cast(null as map<string,string>) as headers", "cast(null as string) as digest").repartition(7)
    got = {r.record_id: r.source_id for r in warc.resolve(rec).collect()}
    want = {}
    for k, t, u, s in rows:
        if t == "revisit":
            earlier = [(s2, k2) for k2, t2, u2, s2 in rows if t2 == "response" and u2 == u and (s2, k2) < (s, k)]
            want[k] = max(earlier)[1] if earlier else None
    assert got == want


def test_tool_calls(spark):
    calls = [(1, "a", 0, "lookup", '{"text":"x","limit":3}', None), (1, "b", 1, "search", '{"strict":true,"text":"é\\n"}', "a"), (1, "c", 2, "search", "[1]", "b"), (1, "d", 3, "lookup", '{"limit":"3"}', "zz"), (1, "e", 4, "nope", "{}", "f"), (1, "f", 5, "search", '{"text":"q"}', "e"), (1, "a", 9, "lookup", "later", None), (1, None, 6, "search", '{"text":"q"}', None), (2, "a", 0, "search", None, None)]
    results = [(1, "a", 1, "r"), (1, "b", 2, None), (1, "x", 3, "lost"), (1, "a", 7, "again"), (1, None, 8, "n")]
    c = spark.createDataFrame(calls, "conv_id int, call_id string, position bigint, name string, arguments string, after string")
    r = spark.createDataFrame(results, "conv_id int, call_id string, position bigint, content string")
    got = {(x.conv_id, x.call_id, x.status): x for x in chat.link(c, r).orderBy("position").collect()}
    find = lambda conv, call: next(v for k, v in got.items() if k[:2] == (conv, call))
    assert (find(1, "a").status, find(1, "a").level, find(1, "a").n_calls, find(1, "a").n_results) == ("linked", 0, 2, 2)
    assert find(1, "a").message == '{"arguments":{"limit":3,"text":"x"},"call_id":"a","conv_id":1,"name":"lookup","result":"r"}'
    assert (find(1, "b").status, find(1, "b").level) == ("linked", 1)
    assert list(find(1, "c").errors) == ["not_an_object"] and find(1, "c").level == 2
    assert list(find(1, "d").errors) == ["type:limit", "missing:text", "unresolved"] and find(1, "d").level == 0
    assert find(1, "e").status == "invalid" and find(1, "e").level is None and find(1, "f").status == "cyclic"
    assert find(1, "x").status == "no_call" and find(2, "a").status == "invalid"
    assert chat.link(c.where("1 = 0"), r.where("1 = 0")).isEmpty()


def test_repeated_and_missing_identifiers_keep_every_call(spark):
    q = '{"text":"%s"}'
    calls = [(1, "k", 0, "search", q % "a", None), (1, "k", 2, "search", "[1]", "k"), (1, "k", 4, "search", q % "c", "k"), (1, "z", 5, "search", q % "z", "k"), (1, None, 6, "search", q % "n", None), (1, None, 7, "search", q % "m", None), (None, "k", 8, "search", q % "o", None), (None, "k", 8, "search", q % "o", None)]
    results = [(1, "k", 1, "ra"), (1, "k", 3, "rb"), (1, "x", 1, "u"), (1, "x", 2, "v"), (1, None, 9, "w")]
    c = spark.createDataFrame(calls, "conv_id int, call_id string, position bigint, name string, arguments string, after string")
    r = spark.createDataFrame(results, "conv_id int, call_id string, position bigint, content string")
    got = chat.link(c, r).orderBy("conv_id", "call_id", "position").collect()
    assert len(got) == len(calls) + 3  # two unmatched results of x and one without an identifier
    assert [(x.position, x.status, x.level, x.n_calls, x.n_results) for x in got if (x.conv_id, x.call_id) == (1, "k")] == [(0, "linked", 0, 3, 2), (2, "invalid", 1, 3, 2), (4, "no_result", 2, 3, 2)]
    assert [x.seq for x in got if (x.conv_id, x.call_id) == (1, "k")] == [1, 2, 3]
    assert [(x.level, x.seq) for x in got if x.call_id == "z"] == [(3, 4)]
    assert [(x.position, x.status, x.n_results) for x in got if x.call_id == "x"] == [(1, "no_call", 2), (2, "no_call", 2)]
    assert sorted((x.position, x.status) for x in got if x.conv_id == 1 and x.call_id is None) == [(6, "no_result"), (7, "no_result"), (9, "no_call")]
    assert sum(x.conv_id is None for x in got) == 2 and sum('"ra"' in x.message or '"rb"' in x.message for x in got) == 2


def test_arguments_are_canonical_by_value(spark):
    cases = {
        '{"a":1e2}': '{"a":100}',
        '{"a":100.0}': '{"a":100}',
        '{"a":100}': '{"a":100}',
        '{"a":[0.10, 1E-1,-0.0,2.5]}': '{"a":[0.1,0.1,0,2.5]}',
        '{"b":"1e2 \\" 3.0 \\\\","a":1.5E+3}': '{"a":1500,"b":"1e2 \\" 3.0 \\\\"}',
        '{"a":12345678901234567890}': '{"a":12345678901234567890}',
        '{"a":0.0000000015}': '{"a":1.5E-9}',
        '{"a":1.5e-9}': '{"a":1.5E-9}',
        '{"a":1,"a":2}': None,
        '{"a":{"b":1,"b":2}}': None,
        "{'a':1}": None,
        '{"a":1': None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.v for r in df.select("raw", F.to_json(chat.parsed(F.col("raw"))).alias("v")).collect()} == cases
    why = {r.raw: r.w for r in df.select("raw", chat._no_object(F.col("raw")).alias("w")).collect()}
    assert [k for k, w in why.items() if w == "duplicate_key" and cases[k] is None] == ['{"a":1,"a":2}', '{"a":{"b":1,"b":2}}']
    calls = [(1, str(k), k, "lookup", f'{{"text":"{"t" * n}","limit":{x}}}', None) for k, (x, n) in enumerate([("1e2", 1), ("100.0", 1), ("100", 500_000), ("1.5", 1)])]
    c = spark.createDataFrame(calls, "conv_id int, call_id string, position bigint, name string, arguments string, after string").withColumns({"level": F.lit("x"), "seq": F.lit("y")})
    got = chat.link(c, spark.createDataFrame([], "conv_id int, call_id string, position bigint, content string")).orderBy("position").collect()
    assert [list(r.errors) for r in got] == [[], [], [], ["type:limit"]] and got[0].message.replace('"0"', "") == got[1].message.replace('"1"', "") and len(got[2].message) > 500_000


def test_numbers_within_hot_groups(spark):
    from lattica.llm.shared import ranked

    rows = [(0, k % 7, k) for k in range(500)] + [(g, 0, k) for g in range(1, 20) for k in range(g)]
    df = spark.createDataFrame(rows, "g int, o int, part int").repartition(5)
    got = ranked(df, ["g"], ["o", "part"], "nth")
    want = {}
    for g, o, k in sorted(rows):
        want[g, o, k] = sum(r[0] == g and r <= (g, o, k) for r in rows)
    assert got.columns == ["g", "o", "part", "nth"] and {tuple(r)[:3]: r.nth for r in got.collect()} == want
    assert ranked(df.where("1 = 0"), ["g"], ["o"], "nth").isEmpty()


@pytest.mark.parametrize("name", ["op3_decontaminate", "op4_quality_rules", "op8_warc_revisits", "op10_tool_calls"])
def test_queries_as_in_sql(spark, name):
    import duckdb

    from lattica.llm import queries

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = ", ".join(got.columns)
    want = db.execute(f"select {columns} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def _model():
    return toxicity.Model(np.linspace(-1, 1, 1 << toxicity.BITS).astype(np.float32), 0.1)


APPENDING = {
    "urls": (lambda d, _: urls.judge(d, urls.Model(), url="text"), ["host", "path", "rule", "score", "verdict"]),
    "contamination": (lambda d, b: decontaminate.scan(d, b), ["contamination"]),
    "quality": (lambda d, _: quality.ledger(quality.measure(d), names=quality.measured_names(d)), [*quality.MEASURES, "failures"]),
    "bpe ids": (lambda d, _: bpe.encode(d), ["ids"]),
    "bpe digests": (lambda d, _: bpe.digests(d, ids="ids"), ["digests", "ids"]),
    "toxicity": (lambda d, _: toxicity.score(d, _model()), ["score"]),
    "trees": (lambda d, _: token_counts.trees(d), ["tree"]),
    "counts": (lambda d, _: token_counts.counts(d.withColumn("edits", F.lit(None).cast(token_counts.EDITS))).drop("edits"), ["counts"]),
}
FILTERING = {
    "toxicity": lambda d, _: toxicity.reject_toxic(d, d.select("doc_id", F.lit(0).alias("toxic"))),
    "quality": lambda d, _: quality.apply_policy(d, "base-1"),
    "near-duplicates": lambda d, _: minhash.distinct_documents(d),
}


@pytest.mark.parametrize("name", [*APPENDING, *(f"filter {k}" for k in FILTERING)])
def test_columns_of_the_input_survive(spark, name):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns with the names of all new and inner ones."""
    taken = sorted({c for _, new in APPENDING.values() for c in new} | {"x_length", "x_tail1", "rule_verdict", "measured", "id", "n", "row", "key", "rep", "toxicity", "contamination_before", "__n", "__id"})
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(6, TEXTS[6])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in taken})
    bench = spark.createDataFrame([(1, "lazy dog")], "item_id int, text string")
    if name.startswith("filter "):
        run, new = FILTERING[name.removeprefix("filter ")], []
    else:
        run, new = APPENDING[name]
    got = run(d, bench)
    assert got.columns == [*d.columns, *(f"_{c}" for c in new)]
    found = got.select(*d.columns).collect()
    assert {tuple(r) for r in found} <= {tuple(r) for r in d.collect()} and (not new or len(found) == len(rows))
    assert all(r[c] == f"{c}:{r.doc_id}" for r in found for c in taken)
    empty = run(d.where("1 = 0"), bench)
    assert empty.columns == got.columns and empty.isEmpty()


def test_subword_gradients_by_brute_force():
    rng = np.random.default_rng(2)
    words = [b"alpha", b"alphas", b"beta", b"x", b"gamma" * 3]
    rows = [(list(rng.choice(words, n, replace=False)), rng.integers(1, 4, n), int(k % 2)) for k, n in enumerate([3, 2, 5, 1, 4])] + [([], np.empty(0, int), 1)]
    texts = toxicity._Texts(rows)
    texts.deal()
    dense = np.zeros((len(rows), len(texts.used)))
    for k, (ws, counts, _) in enumerate(rows):
        for w, c in zip(ws, counts, strict=True):
            buckets, _ = toxicity.subwords([w])
            for b in buckets:
                dense[k, np.searchsorted(texts.used, b)] += c / counts.sum() / len(buckets)
    weight, error = rng.normal(size=len(texts.used)), rng.normal(size=len(rows))
    assert np.allclose(texts.forward(weight), dense @ weight, atol=1e-6) and np.allclose(texts.back(error), dense.T @ error, atol=1e-6)
    y = np.array([r[2] for r in rows], float)
    params = [rng.normal(size=(len(texts.used), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]

    def loss():
        z = dense @ params[0] @ params[1] + params[2]
        return -(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(y)), y.astype(int)].sum()

    grads = toxicity._gradients(texts, params, toxicity._probability(texts, params) - y)
    for param, grad in zip(params, grads, strict=True):
        for at in [tuple(int(rng.integers(n)) for n in param.shape) for _ in range(8)]:
            was = param[at]
            param[at] = was + 1e-5
            up = loss()
            param[at] = was - 1e-5
            down = loss()
            param[at] = was
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_model_scores_as_its_embeddings_do():
    model = _model()
    texts = ["some words, some WORDS again", "", None, "é" * 40 + " x"]
    raw = [(t or "").encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, p in zip(texts, got, strict=True):
        found = [w for w, n in toxicity.bag(t).items() for _ in range(n)]
        logit = model.bias + (np.mean([model.weight[toxicity.subwords([w])[0]].astype(float).mean() for w in found]) if found else 0)
        assert abs(p - 1 / (1 + np.exp(-logit))) < 1e-9


def test_toxicity_on_few_rows_and_unseen_misspellings(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for sf in ("sf0.001", "sf0.01"):
        got = toxicity.op6_toxicity(spark, f"/root/testdata/{sf}").select("score", "predicted").collect()
        assert len({r.score for r in got}) > 5 and {r.predicted for r in got} == {0, 1}
    model = toxicity.learned(docs, labels)
    listed = docs.join(labels.where("toxic = 1"), "doc_id").select("text").collect()
    known = {w for r in listed for w in toxicity.bag(r.text)}
    weight = {w: float(model.weight[toxicity.subwords([w])[0]].mean()) for w in known if w.isascii() and len(w) > 5}
    worst = sorted(weight, key=weight.get)[-5:]
    plain = " ".join(PROSE)
    for w in worst:
        near = w[:-1] + w[-1:] * 2
        assert near not in known
        data = [f"{near.decode()} {plain}".encode(), plain.encode()]
        p = model.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert p[0] > p[1]


def test_chunks_start_at_boundaries_and_are_forgotten_without_harm(monkeypatch):
    import re as regexp

    from lattica.llm import chunks

    odd = [" ", "  a", "a ", " a b", "a  b", "a \n b", "a  b", "a  b", "a 　b", "a  b", "a  b", "a —b", "a あb", "a \x85b", "a \x1cb", "", "é è ", " €"]
    for rows in (odd, odd[::-1], ["a", " b"], ["a ", "b"], []):
        raw = [t.encode() for t in rows]
        edges = np.cumsum([0, *map(len, raw)])
        starts = chunks.starts_of(np.frombuffer(b"".join(raw), np.uint8), edges).tolist()
        want = []
        for t, lo in zip(rows, edges, strict=False):
            at = [m.start() for m in regexp.finditer(r" (?=\S)", t)]
            want += sorted({lo + len(t[:k].encode()) for k in [0, *at]}) if t else []
        assert starts == want, rows
    calls = []

    def encode(names):
        calls.append(len(names))
        ids = [[len(n), n[0]] * (len(n) % 3) for n in names]
        return names, np.array([x for i in ids for x in i], np.uint16), np.array(list(map(len, ids)))

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{k}" * int(k % 5 + 1) for k in range(300)] + ["x" * 200], 40)) for _ in range(60)] + [None, ""]
    plain = [x.tolist() for x in chunks.Chunks(encode, np.dtype("<u2")).rows(pa.array(texts))]
    few = sum(calls)
    monkeypatch.setattr(chunks, "GROUP", 500)
    small = chunks.Chunks(encode, np.dtype("<u2"), limit=40)
    assert [x.tolist() for x in small.rows(pa.array(texts))] == plain and plain[-2:] == [[], []]
    assert small.young.n < 40 + 60 and sum(calls) - few > few
    monkeypatch.setattr(tk, "hash_spans", lambda b, starts, ends: np.zeros(len(starts), np.uint64))
    assert [x.tolist() for x in chunks.Chunks(encode, np.dtype("<u2")).rows(pa.array(texts))] == plain
