"""Substring dedup, ranked search and the conversation trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sluicework.llm import lexical_search, prefix_trie, substring_dedup, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# Word numbers ----------------------------------------------------------------

@pytest.mark.parametrize("block", [5, 64, 1 << 19])
def test_word_hashes(monkeypatch, block):
    """Equal words have equal numbers, others don't, wherever blocks and texts end."""
    monkeypatch.setattr(word_hashes, "BLOCK", block)
    word_hashes._powers.cache_clear()
    draw = random.Random(1)
    texts = [None, "", " \t", "a", "é ü x 漢字", "one\ntwo\x0bthree\x0cfour\rfive", "x" * 200] + [
        "".join(draw.choice("ab é\n") for _ in range(draw.randrange(60))) for _ in range(100)]
    column = pa.array(["skipped", *texts]).slice(1)
    for alphabet, words in ((substring_dedup.ALPHABET, WORD.findall), (lexical_search.ALPHABET, lambda t: TERM.findall(t.translate(UPPER)))):
        found, first = word_hashes.word_hashes(*word_hashes.text_bytes(column), alphabet)
        flat = [w for t in texts for w in words(t or "")]
        assert np.diff(first).tolist() == [len(words(t or "")) for t in texts] and len(found) == len(flat)
        number = dict(zip(flat, found.tolist(), strict=True))
        assert [number[w] for w in flat] == found.tolist() and len(set(number.values())) == len(number)
    word_hashes._powers.cache_clear()


# Substring dedup -------------------------------------------------------------

def kept_words(texts):
    words = [WORD.findall(t or "") for t in texts]
    windows = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


def repeating_texts():
    draw = random.Random(7)
    own = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, short = own(60), own(34)
    texts = [None, "", "  \n", "a", "a " * 300, "a b " * 80, " ".join(own(40)), "é" * 50_000]
    texts += [" ".join(own(draw.randrange(50)) + passage + own(draw.randrange(50))) for _ in range(12)]
    texts += [" ".join(own(20) + passage[k:k + n] + own(20)) for k, n in ((0, 34), (5, 35), (20, 36), (25, 35), (30, 30))]
    texts += [" ".join(own(3) + short + own(3)) for _ in range(4)]
    twice = own(45)
    texts += ["\t".join(twice + own(10) + twice), " ".join(own(5000)), " ".join(own(36))]
    near = own(200)
    texts += [" ".join(near), " ".join([*near[:90], "changed", *near[91:]]), " ".join([*near[:40], "x", *near[41:150], "y"])]
    return texts + [texts[-1], texts[6], texts[6]]


def test_substring_dedup(spark):
    """Passages at, below and over the length, overlapping and periodic ones, repeated rows, rows without an id, clashing names."""
    texts = repeating_texts()
    rows = [(None if i in (7, 9) else i // 2, t, i, "x", -1, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, starts string, n_words int, repeats string").repartition(5)
    found = substring_dedup.substring_dedup(docs)
    assert found.columns == ["doc_id", "text", "row", "starts", "n_words", "n_removed", "repeats"]
    words, kept = kept_words(texts)
    got = {r.row: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, (w, k) in enumerate(zip(words, kept, strict=True)):
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(w) - len(k))
        assert got[i].text == (None if texts[i] is None else " ".join(k))
        assert got[i].doc_id == rows[i][0] and sum(r.length for r in got[i].repeats) == len(w) - len(k)
        assert all(r.length >= 35 for r in got[i].repeats)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_hot_passage(spark):
    """A passage that a third of many documents have, each elsewhere."""
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [" ".join([f"a{i}-{j}" for j in range(draw.randrange(30))] + ([passage] if i % 3 == 0 else []) + [f"b{i}"]) for i in range(3000)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_removed == (50 if r.doc_id % 3 == 0 else 0) for r in found) and len(found) == len(texts)


def test_anchors_are_content():
    """Equal windows have their anchor at the same distance, with the same hashes, whatever stands around."""
    draw = random.Random(3)
    words = [f"w{draw.randrange(3)}" for _ in range(900)]
    hashes, first = word_hashes.word_hashes(*word_hashes.text_bytes(pa.array([" ".join(words[:400]), " ".join(words[400:]), "a"])), substring_dedup.ALPHABET)
    text, start, n, off, anchor, span = substring_dedup.anchors(hashes, first)
    seen = {}
    for t, s, k, o, a in zip(text, start, n, off, anchor, strict=True):
        own = words[:400] if t == 0 else words[400:]
        for i in range(s, s + k):
            window = tuple(own[i:i + 35])
            assert len(window) == 35 and 0 <= s + o - i <= 23
            assert seen.setdefault(window, (s + o - i, a)) == (s + o - i, a)
    assert sum(n) == 366 + 466


# Ranked search ---------------------------------------------------------------

def ranked(docs, items, top=10):
    """Rows (item, rank, doc_id, score) by plain integers."""
    terms = [TERM.findall((t or "").translate(UPPER)) for _, t in docs]
    held = [t for t in terms if t]
    n_docs, total = len(held), sum(map(len, held))
    df = Counter(x for t in held for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for k, t in enumerate(terms):
            if not t:
                continue
            m, tf = 25 + 75 * len(t) * n_docs // total, Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m))
                        for x in TERM.findall((text or "").translate(UPPER)) if x in tf)
            if score > 0:
                scores.append((-score, docs[k][0] is None, docs[k][0] or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def search_case(seed, n_docs):
    draw = random.Random(seed)
    names = [f"T{i}é" if i % 7 == 0 else f"Term{i}" for i in range(60)]
    pick = lambda n: " ".join(draw.choice(names[:draw.choice([5, 20, 60])]) for _ in range(n))
    docs = [(i, pick(draw.randrange(1, 40))) for i in range(n_docs)]
    docs += [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "-- !"), (None, pick(9)), (3, docs[3][1]), (3, docs[3][1])]
    items = [(i, pick(draw.randrange(1, 15))) for i in range(12)] + [(50, None), (51, "nothing-like-this"), (52, "term1 TERM1 term1"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_lexical_search(spark, monkeypatch, block):
    """Ties, repeated rows and terms, items without terms, several blocks of queries."""
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    docs, items = search_case(block, 300)
    found = lexical_search.lexical_search(
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int").repartition(4),
        spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, query string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(docs, items)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.lexical_search(docs.limit(0), items).count() == 0
    assert lexical_search.lexical_search(docs, items.limit(0)).count() == 0
    assert lexical_search.lexical_search(docs, items).count() == 1


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_bounds_hold(monkeypatch, width):
    """The best are the same whatever the width of the sketches and the number of documents that are looked at together."""
    monkeypatch.setattr(lexical_search, "WIDTH", width)
    draw = np.random.Generator(np.random.PCG64(width))
    known = np.sort(draw.integers(0, 1 << 63, 40, dtype="uint64"))
    queries = pd.concat([pd.DataFrame({"query": q, "term": np.sort(draw.choice(known, 5, replace=False)), "times": [1, 2, 1, 1, 3]}) for q in (2, 5)])
    weight = draw.integers(0, 9000, 40)
    docs = []
    for d in range(400):
        terms = np.sort(draw.choice(40, draw.integers(0, 12), replace=False))
        docs.append((d, d // 2, int(draw.integers(1, 50)), terms.astype("int32"), draw.integers(1, 4, len(terms)).astype("int32")))
    frame = pd.DataFrame(docs, columns=["row", "doc_id", "n", "terms", "tf"])
    results = []
    for together in (1, 30, 400):
        block = lexical_search.Block(queries, known, weight, 10)
        for at in range(0, len(frame), together):
            block.offer(frame.iloc[at:at + together], 400, 9000)
        results.append(block.result().values.tolist())
    scores = {q: sorted((-sum(c * weight[np.searchsorted(known, t)] * int(10**9 * f // (1000 * f + 8 * (25 + 75 * n * 400 // 9000)))
                             for t, c in zip(part["term"], part["times"], strict=True) for x, f in zip(terms.tolist(), tf.tolist(), strict=True)
                             if known[x] == t), d, row) for row, d, n, terms, tf in docs) for q, part in queries.groupby("query")}
    want = [[q, d, row, -s] for q in (2, 5) for s, d, row in scores[q][:10] if s < 0]
    assert results == [want] * 3


# Conversations ---------------------------------------------------------------

def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    members, children = defaultdict(list), defaultdict(int)
    rebuilt = {}
    for c, v in convs.items():
        h, head = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        rebuilt[c] = (*convs.get(head, [])[:h], *v[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children.get(n)
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    ends = {n: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(n)))) for n, m in members.items()}
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children.get(n, 0), leaves[n], saved[n],
                    hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=repr)


def conversations():
    draw = random.Random(11)
    rows = [(c, t, draw.choice(["user", "bot", None]), draw.choice(["hi", "é ü", "a b", None, ""])) for c in [*range(0, 40), 100, 101, 150, 203, -5, -150]
            for t in range(draw.choice([1, 1, 2, 3, 6, 9]))]
    rows += [(300 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]  # one conversation, many times
    rows += [(700, t, "u", "deep" if t % 2 else "er") for t in range(300)] + [(701, t, "u", "deep" if t % 2 else "er") for t in range(250)]
    rows += [(7, None, "user", "first"), (7, None, "bot", "first"), (8, 1, "x", "tie"), (8, 1, "y", "tie"), (9, 0, "user", "hi"), (9, 0, "user", "hi"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("small", [1, 20, 50_000])
def test_prefix_trie(spark, small):
    """Deep and repeated conversations, ties, nulls, heads that aren't there; in rounds down to single nodes, or in one task."""
    rows = conversations() if small > 1 else [r for r in conversations() if r[0] is None or r[0] < 120]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string").repartition(3)
    found = prefix_trie.prefix_trie(df, small)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0


def test_ends_in_chunks(spark, monkeypatch):
    """Members are joined in chunks whose digest is that of the whole list."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(1000 + 100 * c, 1, "u", "same") for c in range(100)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_centroid_sums(shape):
    draw = random.Random(2)
    n = 200
    parent = [-1] + [{"path": i - 1, "star": 0, "random": draw.randrange(i)}[shape] for i in range(1, n)]
    values = [(draw.randrange(5), draw.randrange(100)) for _ in range(n)]
    want = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        for k in range(2):
            want[parent[i]][k] += want[i][k]
    assert prefix_trie.gains(list(range(n)), parent, values) == want
