"""Toxicity by multiple-instance learning.

Only documents have labels.  A document is a bag of sentences: it is toxic if some sentence
is, so its score is the noisy-or of its sentences' scores, ``1 - prod(1 - p)``.  A
sentence's score is a logistic function of its distinct words; its weights are learned from
the document labels through the noisy-or, which puts the blame on the sentences that toxic
documents have and others don't.  The same scores then locate the sentences.

The fit reads a bounded sample, at most ``MAX_LABELLED`` labelled documents, picked by a
hash of ``doc_id``; its words are counted and its sentences cut to the chosen words by
Spark, so that only short lists of numbers come to the driver.  Scoring is a pass over
whole texts without a shuffle.

A sentence without a known word scores 0, and so do null and empty texts.  Without labels of both
kinds every score is 0.  A document with several labels is toxic if one says so; null
labels are left out.  Repeated rows are scored each; further columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Labelled documents that the fit reads at most.
MAX_LABELLED = 20_000
#: Words and stems that may have a weight.
MAX_WORDS = 2_000
#: A stem is the first so many letters of a longer word; it stands with a hyphen.
STEM = 5
#: A word or stem gets a weight if so many labelled documents have it, and if toxic ones
#: have it more often by so many standard deviations.
MIN_DOCUMENTS, MIN_LEAN = 3, 4.0
THRESHOLD = 0.7
#: Full passes of gradient descent over the sample, and the deviation that weights are expected to have.
STEPS, SPREAD = 400, 3.0

SENTENCE_END = r"[.!?\n\r]+"
WORD = r"[^\W\d_]+"


def held_out(parts: int, rest: int) -> Column:
    """Whether a document's id keeps it out of learning."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == rest


def known_in(sentence: str, known: dict) -> list[str]:
    """The words and stems of a sentence in lower case that are among the known ones."""
    words = {*re.findall(WORD, sentence)}
    return sorted((words | {f"{w[:STEM]}-" for w in words if len(w) > STEM}) & known.keys())


@dataclass(frozen=True)
class Model:
    """Weights of words, and what every sentence with a known word starts from."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences that have a known word."""
        found, at, weights = [], 0, self.weights
        for s in re.split(f"({SENTENCE_END})", text):
            known = known_in(s.lower(), weights)
            if known:
                z = self.bias + sum(map(weights.__getitem__, known))
                found.append((at, at + len(s), 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))))
            at += len(s)
        return found

    def score(self, text: str | None) -> float:
        """The noisy-or of a text's sentences."""
        clean = 1.0
        for _, _, p in self.sentences(text or ""):
            clean *= 1 - p
        return float(1 - clean)


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents, of those that may be learned from; of rows with one doc_id the least text."""
    picked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn the weights from document labels."""
    sample = _sample(docs, labels, max_labelled)
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)([^\W\d_]+)")))
    stems = F.transform(F.filter(found, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("-")))
    words = sample.select("toxic", F.explode(F.array_distinct(F.concat(found, stems))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).where(
        F.col("bad") + F.col("good") >= MIN_DOCUMENTS)
    bad, good = sample.select(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not bad or not good:
        return Model({}, 0.0)
    # How far a word's share of either kind differs, in standard deviations.
    share = (F.col("bad") + F.col("good")) / (bad + good)
    lean = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    chosen = counts.select("word", lean.alias("lean")).where(F.col("lean") >= MIN_LEAN).orderBy(
        F.col("lean").desc(), "word").limit(MAX_WORDS).collect()
    if not chosen:
        return Model({}, 0.0)
    number = {r["word"]: i for i, r in enumerate(chosen)}

    def cut(batches):
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                bags = [[number[w] for w in known_in(s.lower(), number)] for s in re.split(SENTENCE_END, text or "")]
                rows.append((toxic, [b for b in bags if b]))
            yield pd.DataFrame(rows, columns=["toxic", "bags"])

    bags = sample.mapInPandas(cut, "toxic boolean, bags array<array<int>>").collect()
    return _learn([r["word"] for r in chosen], np.array([r["lean"] for r in chosen]), bags)


def _learn(words: list[str], lean: np.ndarray, rows: list) -> Model:
    """Gradient descent (Adam) on the log loss of the noisy-or; kinds weigh as much as they occur."""
    rows = [(r["toxic"], b) for r in rows if (b := r["bags"])]
    label = np.array([t for t, _ in rows], float)
    of_doc = np.repeat(np.arange(len(rows)), [len(b) for _, b in rows])
    sizes = [len(s) for _, b in rows for s in b]
    of_sentence = np.repeat(np.arange(len(of_doc)), sizes)
    word = np.concatenate([s for _, b in rows for s in b]).astype(int)
    w = np.append(np.minimum(lean / 5, 3), -3.0)  # the last is the bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(of_sentence, w[word], len(of_doc)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows)))
        pull = p * (1 - label / np.maximum(1 - clean, 1e-9))[of_doc]
        g = np.append(np.bincount(word, pull[of_sentence], len(w) - 1), pull.sum()) / len(rows)
        g[:-1] += w[:-1] / (SPREAD**2 * len(rows))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(words, w[:-1].tolist(), strict=True)), float(w[-1]))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """The rows with the score of their text."""

    @pandas_udf("double")
    def noisy_or(text: pd.Series) -> pd.Series:
        return text.map(model.score).astype(float)

    return docs.withColumn(score, noisy_or("text"))


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per sentence that scores at least ``threshold``: doc_id, start, length, sentence, score."""

    def located(batches):
        for batch in batches:
            yield pd.DataFrame(
                [(i, a, b - a, t[a:b], p) for i, t in zip(batch["doc_id"], batch["text"], strict=True)
                 for a, b, p in model.sentences(t or "") if p >= threshold],
                columns=["doc_id", "start", "length", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        located, "doc_id string, start bigint, length bigint, sentence string, score double",
    ).withColumn("doc_id", F.col("doc_id").cast(kind))


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    return scored(docs, fit(docs, labels, max_labelled)).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), "text")
    return scored(rows, fit(docs, labels), "_score").where(F.col("_score") < threshold).select(
        *[F.col("_row").getField(c).alias(c) for c in columns])
