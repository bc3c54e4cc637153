"""Language identification by rank-order profiles.

A profile is a list of the most frequent n-grams (one to three letters of words with their
ends marked), most frequent first.  Each language has one, counted over all documents that
may be learned from.  A document's own profile is compared with each: for each of its
n-grams, the places between its rank in both lists, or the length of the list where the
language doesn't have it, are added up.  The language with the smallest sum wins.

Counts are summed in each batch, then shuffled by language and n-gram; the top of each
language is cut before it meets in one task.  The profiles, ``PROFILE`` rows for each
language, go to the tasks; texts stay where they are.

Null text and text without a letter give ``und`` and score 0, as does everything when
there is nothing to learn from.  Ties between n-grams go by their code points, between
languages by name.  Documents without a language are only predicted.  Repeated rows count
each; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.toxicity import held_out

#: Length of a profile.
PROFILE = 400
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_MARK = ord("_")


def words_of(text: str) -> list[str]:
    """The words of a text in small letters."""
    text = text.lower()
    words = _WORD.findall(text)
    letters = "".join(words)
    if not words or letters.isalpha():
        return words
    # Python's \w takes signs for numbers, such as ½ and ②, that are no letters; a pattern without them is tried range by range.
    return _WORD.findall(text.translate({ord(c): " " for c in set(letters) if not c.isalpha()}))


def grams(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some words and their counts.  An n-gram is the number that its code points make, of 21 bits each.

    The words stand in one array with a mark between them.  The mark alone is no n-gram,
    nor is one that has a mark in its middle, since that belongs to two words.
    """
    text = f"_{'_'.join(words)}_".encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(text, "<u4").astype("int64")
    lengths = np.fromiter(map(len, words), "int64", len(words)) + 1
    weight = np.append(np.repeat(np.fromiter(words.values(), "int64", len(words)), lengths), 0)
    letter = c != _MARK
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[letter[1:-1]]
    found, at = np.unique(np.concatenate([c[letter], two, three]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([weight[letter], weight[:-1], weight[:-2][letter[1:-1]]]))
    return found, counts.astype("int64")


def profile(text: str | None, length: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first."""
    words = Counter(words_of(text or ""))
    if not words:
        return np.empty(0, "int64")
    found, counts = grams(words)
    return found[np.lexsort((found, -counts))][:length]


def learn(docs: DataFrame, length: int = PROFILE) -> dict[str, np.ndarray]:
    """A profile for each language of the documents that may be learned from."""

    def counted(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words: Counter = Counter()
                for t in texts:
                    words.update(words_of(t))
                if words:
                    found, counts = grams(words)
                    yield pd.DataFrame({"lang": lang, "gram": found, "n": counts})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(4, 2)).select("lang", "text")
    counts = known.mapInPandas(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= length)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():  # PROFILE rows for each language
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(found[lang])], "int64") for lang in sorted(found)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], length: int = PROFILE) -> DataFrame:
    """The rows' doc_id with lang_pred and score."""
    names = [*profiles]
    sorted_ = {k: (np.sort(p), np.argsort(p)) for k, p in profiles.items()}

    def judged(text: str | None) -> tuple[str, float]:
        own = profile(text, length)
        if not len(own) or not names:
            return UNKNOWN, 0.0
        places, sums = np.arange(len(own)), []
        for k in names:
            values, ranks = sorted_[k]
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            sums.append(np.where(values[at] == own, np.abs(ranks[at] - places), length).sum())
        best = int(np.argmin(sums))
        return names[best], float(1 - sums[best] / (length * len(own)))

    def judge(batches):
        for batch in batches:
            out = [judged(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "lang_pred": [x for x, _ in out], "score": np.array([s for _, s in out], float)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        judge, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def language_id(docs: DataFrame, length: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, learn(docs, length), length).select(
        "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
