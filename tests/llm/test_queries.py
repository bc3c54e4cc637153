"""The operators' queries against their SQL."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from oracle import compare, connect
from test_operators import check_packing

from sluicework.llm import queries, toxicity


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, sf_dir, con, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE[name]) is None


def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_sentencepiece(spark, sf_dir):
    """Against the public library on every document."""
    from sentencepiece import SentencePieceProcessor

    model, docs = SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model")), documents(spark, sf_dir)
    rows = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = model.encode(docs[r.doc_id].text)
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))


def test_toxicity(spark, sf_dir):
    """Scores are what a plain product over the learned model's words gives, and most toxic documents that it hasn't seen are found."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        clean = 1.0
        for *_, p in model.sentences(docs[r.doc_id].text or ""):
            clean *= 1 - p
        assert abs(r.score - (1 - clean)) < 1e-9 and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    known = [r for r in rows if r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in known if r.held_out)
    assert right >= 0.9 * sum(r.held_out for r in known)


def test_language_id(spark, sf_dir):
    """Profiles and out-of-place distances by plain counting, and held-out accuracy."""
    docs = documents(spark, sf_dir)

    def ranked(texts):
        counts = Counter()
        for text in texts:
            for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
                padded = f"_{word}_"
                for n in (1, 2, 3):
                    counts.update(g for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) != "_")
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], int("".join(f"{ord(c):021b}" for c in x[0]), 2)))][:400]

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    profiles = {lang: ranked(d.text for i, d in docs.items() if d.lang == lang and not held[i] and d.text) for lang in
                sorted({d.lang for d in docs.values() if d.lang})}
    rows = queries.op8_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        own = ranked([docs[r.doc_id].text or ""])
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {k: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own)) for k, p in profiles.items()}
        assert r.held_out == held[r.doc_id] and away[r.lang_pred] == min(away.values())
        assert abs(r.score - (1 - min(away.values()) / (400 * len(own)))) < 1e-9
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(right) >= 0.95 * len(right)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = [(i, d.text) for i, d in documents(spark, sf_dir).items()]
    rows = queries.op9_best_fit_packing(spark, sf_dir).collect()
    n, total = check_packing(rows, docs, Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")))
    assert n <= 1.02 * -(-total // 1024) + 1


def test_pipeline(spark, sf_dir):
    """All stages at once give the pieces of documents that every stage keeps."""
    docs = documents(spark, sf_dir)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in rows}
    assert kept <= set(docs) and 0 < len(kept) < len(docs)
    bad = {r.doc_id for r in queries.op1_quality_rules(spark, sf_dir).collect() if not r.kept}
    assert not kept & bad
