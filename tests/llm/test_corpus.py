"""Operators over the corpus as a whole: near-duplicates, toxicity, mixing, repeated passages, vectors, the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as public
import tiktoken
from pyspark.sql import Observation
from pyspark.sql import functions as F

import corpus_pipeline
from runlattice.llm import bagminhash, hnsw, mixing, prefix_bpe, queries, substrings, toxicity
from runlattice.llm.graph import components

WORDS = re.compile("[^\x20\x09-\x0d]+")


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    own = random.Random(5)
    links = [(own.randint(0, 300), own.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union(links, {x for ab in links for x in ab})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# near-duplicates

def bag(text):
    w = WORDS.findall(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def groups(rows):
    """Least doc_id of the near-duplicate group of each row, by all pairs."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    bags = {i: bag(t) for t, i in first.items()}
    holds = collections.defaultdict(set)
    for i, b in bags.items():
        for k in b:
            holds[k].add(i)
    pairs = {(a, b) for same in holds.values() for a in same for b in same if a < b}
    near = [(a, b) for a, b in pairs if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())]
    named = union(near, bags)
    return {i: named[first[t]] for i, t in rows}


def copies(n, seed, edits):
    own = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [own.choice(words) for _ in range(120)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(own.randint(0, edits)):
            text[own.randrange(len(text))] = own.choice(words)
        out.append((i, " ".join(text)))
    return out


def test_near_duplicates_of_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in queries.op2_bagminhash(spark, sf).collect()} == groups(rows)


def test_near_duplicates_in_a_large_group(spark):
    rows = copies(150, 6, 7)
    bagminhash.BLOCK, before = 16, bagminhash.BLOCK
    try:
        got = {r.doc_id: r.component_id for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        bagminhash.BLOCK = before
    want = groups(rows)
    assert np.mean([got[i] == want[i] for i in want]) > 0.98


def test_signatures_are_unbiased():
    own = np.random.default_rng(7)
    for high in (2, 9, 300):
        found, true = [], []
        for _ in range(12):
            element = own.integers(0, 1 << 63, 300).astype(np.uint64)
            a = own.integers(1, high, 300)
            b = a.copy()
            b[:60], b[60:80] = own.integers(1, high, 60), 0
            s = bagminhash.signatures(np.r_[np.zeros(300, int), np.ones((b > 0).sum(), int)], np.r_[element, element[b > 0]], np.r_[a, b[b > 0]], 2, 1024)
            found.append((s[0] == s[1]).mean())
            true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert abs(np.mean(found) - np.mean(true)) < 0.02


def test_first_of_each_keeps_columns(spark):
    rows = [(None, None, 1), (5, "", 2), (5, "a b c d e f g h", 3), (3, "a b c d e f g h", 4), (3, "a b c d e f g h", 4), (7, "q", 1), (None, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = bagminhash.first_of_each(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(3, "a b c d e f g h"), (5, ""), (7, "q")]
    assert bagminhash.near_duplicates(docs).count() == 7 and bagminhash.near_duplicates(docs.limit(0)).collect() == []


# toxicity

def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scored = queries.op3_label_model(spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.75
    assert np.mean([c < 0.5 for c in clean]) > 0.95 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_stems_speak_by_their_share_of_a_text(spark):
    short, long, once = "grobian grobsch ja", "grobian grobsch " + "ja " * 400, "grobian ja"
    docs = spark.createDataFrame([(1, short), (2, long), (3, once), (4, ""), (5, None), (6, "GROBER-grobe grob")], "doc_id long, text string")
    cut = docs.select("doc_id", toxicity.stems_of(toxicity.words_of(F.col("text"))).alias("s")).orderBy("doc_id").collect()
    assert [sorted(set(r.s) - {""}) for r in cut[2:]] == [["grob-", "grobi-"], [], [], ["grob-", "grobe-"]]
    of = toxicity.Terms.of(["ja", "grob-"], ["grob-", "ja"])
    counts = {r.doc_id: r._counts.toArray().tolist() for r in of.transform(docs, toxicity.words_of(F.col("text")), "doc_id").collect()}
    # ja; grob- begins two words or more and its share of them; any and several of the pool's words; its stems
    assert counts[1] == [1, 1, 1, 0, 1] and counts[2] == [1, 0, 1, 0, 0] and counts[3] == [1, 0, 1, 0, 0]
    assert counts[4] == counts[5] == [0] * 5 and counts[6] == [0, 1, 0, 0, 1]


def test_toxicity_learns_stems(spark):
    own = random.Random(9)
    word = lambda: "".join(own.choice(["ba", "do", "gu", "ki", "le", "mo", "nu"]) for _ in range(own.randint(2, 4)))
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = [word() for _ in range(40)] + ["zorp" + word() for _ in range(3)] * toxic
        own.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs, labels).collect()}
    assert got == {i: y for i, _, y in rows}


def test_label_model_finds_voters_that_go_together():
    own = np.random.default_rng(8)
    y = own.random(4000) < 0.2
    right = lambda p: np.where(own.random(4000) < p, np.where(y, 1, 2), np.where(y, 2, 1))
    twin = right(0.7)
    votes = np.column_stack([right(0.9), right(0.8), twin, twin])
    labels = np.where(own.random(4000) < 0.95, y, ~y).astype(int)
    model, p = toxicity.fit_label_model(votes, labels)
    assert any({2, 3} <= set(g) for g in model.groups) and np.mean((p > 0.5) == y) > 0.96


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(None, None, 1), (5, "", 2), (5, "You idiot", 3)], "doc_id long, text string, words int")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.25}
    assert toxicity.scores(docs.limit(0), labels).collect() == [] and toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns


# mixing

def test_schedule_is_within_one_block(spark, sf):
    rows = queries.op4_pfair(spark, sf).collect()
    held = {}
    for r in rows:
        assert held.setdefault(r.slot, r.source) == r.source and r.release <= r.slot < r.deadline
    share = {r.source: r.share for r in rows}
    assert sum(share.values()) == mixing.CYCLE and len({r.position for r in rows}) == len(rows)
    had = collections.Counter()
    for slot in range(max(held) + 1):
        had[held[slot]] += 1
        assert all(abs(had[s] - w * (slot + 1) / mixing.CYCLE) < 1 for s, w in share.items())
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == ids


def test_mixture_by_given_weights(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", i) for i in range(300)] + [(None, None, 1), (None, None, 1)], "doc_id long, source string, slots int")
    weights = spark.createDataFrame([("a", 5), ("b", 4), ("", 1)], "source string, share int")
    got = mixing.mixture(docs, weights, cycle=10, block=2).collect()
    count = collections.Counter(r.source for r in got)
    n = sum(count.values()) / 10
    assert abs(count["a"] - 5 * n) <= 2 and abs(count["b"] - 4 * n) <= 2 and len({r.doc_id for r in got}) == 301
    assert mixing.mixed(docs, weights, 10, 2).columns == docs.columns and mixing.mixture(docs.limit(0)).collect() == []


# repeated passages

def removed(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        w = WORDS.findall(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_repeats_of_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_seed_extend(spark, sf).collect())) == removed(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = substrings.without_repeats(docs)
    assert kept.dtypes == docs.dtypes
    want = {r[0]: r[3] for r in removed(rows)}
    for r in kept.collect():
        assert hashlib.sha256(" ".join(WORDS.findall(r.text)).encode()).hexdigest() == want[r.doc_id] and r.n_chars == len(r.text)


def test_repeats_in_dense_texts(spark):
    own = random.Random(9)
    rows = [(i, " ".join(own.choice("abc") if own.random() < 0.4 else "d" for _ in range(own.randint(0, 120)))) for i in range(150)]
    rows += [(1000 + i, " ".join(["x"] * own.randint(0, 60) + ["y"] * own.randint(0, 9))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, substrings.dedup(docs).collect())) == removed(rows)


def test_repeats_odd_rows(spark):
    w = " ".join(f"w{i}" for i in range(30))
    rows = [(None, None, 1), (5, "", 2), (5, w, 3), (3, w + " x", 4), (3, w + " x", 4), (7, "q " + w, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.dedup(docs).collect())
    assert got == [(0, 0, 0), (3, 31, 0), (3, 31, 0), (5, 0, 0), (5, 30, 30), (7, 31, 30)]
    assert sorted(str(r.text) for r in substrings.without_repeats(docs).collect()) == ["", "", "None", "q", w + " x", w + " x"]
    assert substrings.dedup(docs.limit(0)).collect() == []


# vectors

def cosine_links(rows, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    ids = [i for i, _ in ok]
    named = union([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], [i for i, _ in rows])
    count = dict(zip(ids, near.sum(1).tolist()))
    return {i: (count.get(i, 0), named[i]) for i, _ in rows}


def test_vectors_against_all_pairs(spark):
    own = np.random.default_rng(10)
    centres = own.normal(size=(40, 24))
    x = np.concatenate([c + own.normal(scale=s, size=(k, 24)) for c, s, k in zip(centres, own.uniform(0.05, 0.3, 40), own.integers(1, 60, 40))])
    x = np.concatenate([x, x[:30]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = cosine_links(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and np.mean([got[i][1] == want[i][1] for i in want]) > 0.99


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, float("nan")], 0), (6, [1.0, None], 0), (7, [0.0, 3.0], 1), (8, [1.0, 0.0], 0), (9, [], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(docs).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 8: (2, 1)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 9)}
    assert hnsw.near_duplicates(docs.limit(0)).collect() == []


def bridged(own, groups, length, dims):
    """Chains in planes of their own, each vector 15 degrees from the next; ids are shuffled."""
    ids = own.permutation(groups * length).tolist()
    rows = []
    for _ in range(groups):
        a, b = np.linalg.qr(own.normal(size=(dims, 2)))[0].T
        rows += [(ids.pop(), (np.cos(t) * a + np.sin(t) * b).tolist()) for t in np.radians(15) * np.arange(length)]
    return rows


def test_bridged_vectors_are_one_component(spark):
    rows = bridged(np.random.default_rng(11), 60, 3, 48) + [(1000 + i, v) for i, v in bridged(np.random.default_rng(12), 12, 9, 48)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == cosine_links(rows)


def test_vectors_of_different_lengths_and_few_links(spark):
    """Lengths don't meet; with hardly any links the beams are audited by planted copies and still find the few."""
    own = np.random.default_rng(8)
    x = own.normal(size=(900, 24))
    x[7] = x[3] + 0.02 * x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1001, [2.0, 4.0]), (1002, [1.0, 2.01])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = {i: v for i, v in got.items() if v[0]}
    assert linked == {3: (1, 3), 7: (1, 3), 1000: (2, 1000), 1001: (2, 1000), 1002: (2, 1000)} and len(got) == 903


def test_vectors_whose_audit_fails_or_sees_too_little(spark):
    own = np.random.default_rng(13)
    x = own.normal(size=(3000, 32))
    for pairs in (20, 1000):
        near = x[:pairs] + own.normal(scale=0.18, size=(pairs, 32))
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
        got = {r.node: (r.links, r.component) for r in hnsw.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), beams=(1,)).collect()}
        assert got == {i: w for i, w in cosine_links(rows).items() if w[0]} and len(got) > pairs


# pipeline

def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").checkpoint() if spark.sparkContext.getCheckpointDir() else spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    sizes = [rows.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.stored(stage(spark, rows, sf), "pipeline-test")
        assert rows.columns == docs.columns
        sizes.append(rows.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] <= sizes[4]
    with open(public.path(queries.BPE_RANKS), "rb") as f:
        plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(f.read()), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    want = sorted((r.doc_id, len(plain.encode_ordinary(r.text or ""))) for r in rows.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in last.collect()) == want


def test_toxicity_after_rows_were_observed(spark, sf):
    """An Observation leaves the session with a manager that can't be sent to tasks; scoring must not carry the session there."""
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.scores(docs, labels).collect()
    assert len(scored) == docs.count()
    assert {r.doc_id for r in scored if not r.predicted} == {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
