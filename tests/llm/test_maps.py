"""Operators that are maps over texts: fingerprints, byte pair encoding, token files, page texts, archives."""

import base64
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runlattice.llm import fingerprints, html_text, prefix_bpe, queries, token_files, warc
from runlattice.llm.common import sampled
from runlattice.session import shared_folder

DOCS = "doc_id long, text string"
RANKS = public.path(queries.BPE_RANKS)


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as f:
        data = f.read()
    ranks = prefix_bpe.read_ranks(data)
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return prefix_bpe.encoder_of(data, public.PATTERN), plain


def odd(spark):
    """Null ids and texts, repeated rows, one id twice, and columns whose names the operators use themselves."""
    rows = [(None, None, 1, 1), (5, "", 2, 2), (5, "a b", 3, 3), (3, "w " * 40, 4, 4), (3, "w " * 40, 4, 4), (7, "é\n\t 中文 🎉", 5, 5)]
    return spark.createDataFrame(rows, f"{DOCS}, bucket int, digest int")


# byte pair encoding

def test_encoding_equals_the_library(spark, sf, bpe):
    tool, plain = bpe
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert tool.encode(r.text).tolist() == plain.encode_ordinary(r.text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t  \x1c!1'sß中🎉́\xa0x\0", max_size=30))
def test_encoding_of_any_text(bpe, text):
    tool, plain = bpe
    ids = tool.encode(text).tolist()
    assert ids == plain.encode_ordinary(text)
    assert tool.bpe.decode(ids).decode() == text


def test_prefixes_append_and_edit(bpe):
    tool, own = bpe[0].bpe, random.Random(1)
    for _ in range(60):
        piece = bytes(own.choice(b"theinrandos ") for _ in range(own.randint(1, 120)))
        last = tool.extend(piece)
        assert tool.tokens(last) == tool.merged(piece)
        cut = own.randint(0, len(piece))
        assert tool.extend(piece, tool.extend(piece[:cut])) == last
        start = own.randint(0, len(piece))
        stop = own.randint(start, min(len(piece), start + 9))
        new, redone = tool.edit(piece, last, start, stop, b"xyz"[: own.randint(0, 3)])
        assert redone == tool.extend(new)


def test_pairs_agree_with_merging(bpe):
    tool, own = bpe[0].bpe, random.Random(2)
    ids = list(tool.bytes_of)
    for _ in range(2000):
        a, b = own.choice(ids), own.choice(ids)
        assert tool._follows(a, b) == (tool.merged(tool.bytes_of[a] + tool.bytes_of[b]) == [a, b])


def test_bpe_rows(spark, bpe):
    _, plain = bpe
    got = sorted(prefix_bpe.digests(odd(spark), RANKS, public.PATTERN).collect(), key=str)
    want = []
    for r in odd(spark).collect():
        ids = plain.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert prefix_bpe.encode(odd(spark).limit(0), RANKS, public.PATTERN).collect() == []
    assert sum(len(r.ids) for r in prefix_bpe.encode(odd(spark), RANKS, public.PATTERN).collect()) == sum(w[1] for w in want)


# token files

def crcs(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op9_token_files(spark, sf).orderBy("doc_id").collect()
    tokenizer = Tokenizer.from_file(public.path(queries.WORD_BPE))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == crcs([(d.doc_id, d.text) for d in docs], tokenizer)


def test_token_files_odd_rows(spark):
    path = public.path(queries.WORD_BPE)
    got = sorted(token_files.round_trip(odd(spark), path, 1).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None, 3, 3, 5, 5, 7] and sum(r.n_tokens for r in got[:-1]) == got[-1].start
    assert token_files.round_trip(odd(spark).limit(0), path, 1).collect() == []


def test_one_document_from_a_shard(spark, sf):
    folder = shared_folder(spark, "tokens-test")
    path = public.path(queries.WORD_BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = token_files.write(docs, path, 1, folder)
    shard = token_files.ShardReader(folder, index.orderBy("bucket").first().file)
    text = docs.filter(f"doc_id = {shard.doc_ids[2]}").first().text
    assert shard.document(2).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1]
    assert len(shard.header["dictionary_sha256"]) == 64


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abß É'st.,!5 \n\t\x1cªµİΣ́ñ<|", max_size=25))
def test_words_alone_are_words_in_a_text(text):
    path = public.path(queries.WORD_BPE)
    with open(path, encoding="utf-8") as f:
        tool = token_files._encoder(f.read())
    plain = Tokenizer.from_file(path) if not hasattr(test_words_alone_are_words_in_a_text, "t") else test_words_alone_are_words_in_a_text.t
    test_words_alone_are_words_in_a_text.t = plain
    got = np.frombuffer(tool.encode_all([text + " <|endoftext|>"])[0], "<u4").tolist()
    assert got == plain.encode(text + " <|endoftext|>", add_special_tokens=False).ids


# fingerprints

def test_fingerprints_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    got = {r.doc_id: r for r in queries.op1_syncmers(spark, sf).collect()}
    for i, d in enumerate(docs):
        after = docs[(i + 1) % len(docs)].text
        half = len(d.text) // 2
        new = d.text[: len(d.text) - half] + after[:half]
        own, changed, following = fingerprints.sketches([d.text, new, after])
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.packed(own), fingerprints.packed(changed))
        assert r.near_edited == fingerprints.likeness(own, changed) and r.near_next == fingerprints.likeness(own, following)
    near = [r.near_edited for r in got.values() if r.n_chars > 60]
    assert np.median(near) > 0.25 and np.median([r.near_next for r in got.values()]) < 0.02


def test_syncmers_depend_on_their_own_text_alone():
    own = random.Random(3)
    core = "".join(own.choice("abcdef ") for _ in range(200))
    kept = []
    for around in ("", "xyz" * 9, "q" * 31):
        codes = np.frombuffer((around + core + around).encode("utf-32-le"), "<u4").astype(np.uint64)
        at, h = fingerprints.syncmers(codes, 16, 6)
        inside = (at >= len(around)) & (at + 16 <= len(around) + len(core))
        kept.append(list(zip((at[inside] - len(around)).tolist(), h[inside].tolist())))
    assert kept[0] and kept[0] == kept[1] == kept[2]
    a, b = fingerprints.unpacked(fingerprints.packed(fingerprints.sketches([core])[0]))
    assert fingerprints.likeness((a, b), fingerprints.sketches([core])[0]) == 1.0


def test_near_copies_of_any_length_are_alike():
    own = random.Random(6)
    for n in [*range(60, 200, 7), 126, 127, 128, 129, 1000]:
        text = "".join(own.choice("abcdefghijklmnop ") for _ in range(n + 2))
        short, long = fingerprints.sketches([text[:n], text])
        other = fingerprints.sketches(["".join(own.choice("abcdefghijklmnop ") for _ in range(n))])[0]
        assert fingerprints.likeness(short, long) >= 0.85 and fingerprints.likeness(short, other) < 0.1
        assert fingerprints.likeness(short, long) == fingerprints.likeness(long, short)


def test_fingerprints_odd_rows(spark):
    got = fingerprints.fingerprints(odd(spark)).collect()
    assert len(got) == 6 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert fingerprints.fingerprints(odd(spark).limit(0)).collect() == []
    one = fingerprints.fingerprints(odd(spark).filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# main text

def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_main_text_of_all_pages(spark, sf):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_tree_model(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.fixture(scope="module")
def model(spark, sf):
    return html_text.fit([r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(40).collect()])


def test_held_out_layouts(model):
    passages = [" ".join(f"word{i * j % 97}," for j in range(40)) + "." for i in range(1, 30)]
    pages = [html_text.parse(x) for x in html_text.layouts(passages, 80, seed=99)]
    label = np.concatenate([html_text._marked(p) for p in pages])
    parent, depth, kind, x = html_text.features(pages)
    chance, _ = html_text.marginals(parent, depth, kind, x @ model[0], model[1])
    runs = np.concatenate([[bool(t) for t in p.text] for p in pages])
    assert ((chance > 0.5) == label)[runs].mean() > 0.97


def test_messages_give_exact_marginals():
    own = np.random.default_rng(4)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    depth, kind = np.array([0, 1, 1, 2, 2, 2]), np.array([3, 0, 1, 2, 0, 1])
    score, tables = own.normal(size=6), own.normal(size=(html_text.N_KINDS, 2, 2))
    total, each = 0.0, np.zeros(6)
    for code in range(64):
        y = np.array([code >> i & 1 for i in range(6)])
        w = np.exp(score @ y + sum(tables[kind[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += w
        each += w * y
    assert np.allclose(html_text.marginals(parent, depth, kind, score, tables)[0], each / total)


def test_pages_of_other_makes(model):
    page = """<html><head><title>x</title></head><body><header><nav><a href=/>Home</a></nav></header>
    <div class="cookie-banner"><p>We use cookies on this site to improve things. Accept?</p><button>OK</button></div>
    <div class="main-content"><h1>Fish &amp; chips</h1><p>The first paragraph has a number of words, and it goes on.
    </p><div class="ad">Buy now, cheap stuff for everyone.</div><p>Second <a href=x>one</a>&nbsp;too<p>Third, unclosed, has some more words in it.</div>
    <div class="comments"><div class="comment"><p>Great article, I really loved reading it. Thanks!</p></div></div>
    <footer><p>Copyright, all rights reserved.</p></footer><script>var x="<p>no</p>";</script></body></html>"""
    got = html_text.texts_of([page, "", "<p>", "plain < text", "<!-- open"], *model)
    assert got[0].split("\n") == ["Fish & chips", "The first paragraph has a number of words, and it goes on.", "Second one too", "Third, unclosed, has some more words in it."]
    assert got[1:] == ["", "", "plain < text", ""]


@pytest.mark.parametrize("name", ["SCRIPT", "Style", "TEXTAREA", "NoScript", "IFRAME", "SVG"])
def test_upper_case_elements_close_beside_any_letter(name):
    page = html_text.parse(f"<body><p>İstanbul first</p><{name}>var x = '<p>no</p>';</{name}><p>and last</p></body>")
    assert [t for t in page.text if t] == ["İstanbul first", "and last"]


def shown(source):
    return [t for t in html_text.parse(source).text if t]


def test_quotes_open_values_only():
    assert shown("<p title=it's>One two.</p><p>I don't know</p><p>end</p>") == ["One two.", "I don't know", "end"]
    assert shown('<p title="a > b" x=\'>\'>One</p>') == ["One"]
    assert shown('<p title=a="b>One</p><p class = "x">two') == ["One", "two"]
    assert shown('<p title="never closed>One</p>two') == ["One", "two"]
    assert shown('<p>a <b title=">" c <i>d') == ["a d"]
    assert shown('<p>a <b title=">" c') == ["a \" c"]  # quotes hide every end: tags end without them
    assert shown("a <b") == ["a <b"] and shown("a <b<!-- c --> d") == ["a d"]


@pytest.mark.parametrize(
    "source",
    ["<a " * 350_000, "<!" * 500_000, '<a b=">"' * 130_000, '<a b="' * 160_001, "<svg>" * 200_000, "<head>" + "<!-- -->" * 120_000 + "<body>", "<head>" + "<script>" * 120_000],
)
def test_odd_markup_is_read_once(source):
    before = time.process_time()
    html_text.parse(source)
    assert time.process_time() - before < 5


@pytest.mark.parametrize("source", ["<div>" * 8000 + "words " * 160_000 + "</div>" * 8000, "<ul><li>" * 8000 + "words " * 160_000])
def test_deep_pages(source, model):
    before = time.process_time()
    html_text.texts_of([source], *model)
    assert time.process_time() - before < 10
    assert shown(source) == ["words " * 159_999 + "words"]


def test_sample_of_pages_with_one_key(spark):
    rows = spark.createDataFrame([(None, None, f"<article><p>Page {i % 3} has some words.</p></article>") for i in range(40)], "page_id long, url string, html string")
    assert sampled(rows, "page_id", "html", 10).count() == 3
    assert sampled(rows.limit(0), "page_id", "html", 10).collect() == []


def test_page_rows(spark):
    rows = [(None, None, None, "a"), (1, "u", "", "b"), (1, "u", "", "b"), (2, "v", "<p>" + "word " * 50_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_texts(pages).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:3] == [0, 0, 0]
    assert html_text.main_texts(pages.limit(0)).collect() == []


# archives

def test_warc_round_trip(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [(900, None), (901, ""), (902, "é"), (903, "é"), (904, "é")]
    last = {}
    for page_id, text in rows:
        last[text or ""] = max(page_id, last.get(text or "", -1))
    want = []
    for page_id, text in rows:
        data, to = (text or "").encode(), last[text or ""]
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == page_id else "revisit", None if to == page_id else to))
    pages = spark.createDataFrame([(p, "u\r\nx y", t, 0) for p, t in rows], "page_id long, url string, html string, offset int")
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == sorted(want)


def test_warc_selected_and_small(spark):
    pages = spark.createDataFrame([(None, None, "a"), (2, "u", "a"), (3, "k", "c"), (3, "k", "d"), (4, "k", "d"), (5, "z", "dd"), (6, "z", "dd")], "page_id long, url string, html string")
    folder = shared_folder(spark, "warc-test")
    index = warc.write(pages, folder, least=2)
    assert {(r.page_id, r.record_type) for r in index.collect()} >= {(None, "response"), (5, "revisit"), (6, "response")}
    got = warc.read(index.filter("page_id in (3, 5)"), folder).collect()
    assert sorted((r.page_id, bytes(r.payload or b"-")) for r in got) == [(3, b"c"), (3, b"d"), (5, b"-")]
    assert warc.round_trip(pages.limit(0)).collect() == []
    assert list(warc.ranges([0, 10, 200_000], [10, 5, 7])) == [(0, 2, 0, 15), (2, 3, 200_000, 200_007)]
