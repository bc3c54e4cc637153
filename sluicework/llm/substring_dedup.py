"""Substring dedup by seed and extend: words of passages that occur elsewhere are removed.

A passage is a repeat if its sequence of at least ``LEAST`` words also starts at another place, in another
document or the same one.  All words that lie in a repeat go; repeats are judged on the texts as they came.

1. Seeds: a window of ``LEAST`` words has one anchor, the first of its runs of ``SEED`` words with the least hash
   (winnowing).  Equal windows have the same anchor at the same distance, so that joining places on equal
   anchors misses none.  Neighbouring windows mostly share their anchor: a row stands for an
   anchor's place and its span, the words of all windows that it is the anchor of.
2. Places whose anchor occurs once go no further.  The others form groups.
3. Extension: places of a group whose whole spans are equal extend over them; one hash of the span tells.  These
   are nearly all places inside of repeats.  At the edges of repeats spans differ: there one place for each
   different span of the group is extended window by window, left and right of the anchor, and a window
   that two of them have is a repeat.  So a passage with n copies costs n rows, not the n * n pairs
   of its copies.
4. Spans and windows that overlap or touch join to maximal repeats, whose words go.

Words are numbered by 64-bit hashes, an anchor and its window together by 128 bits, so that places
which only seem equal are not to be expected in any corpus.  Groups and spans that many rows share are settled by
a broadcast of at most a thousand keys, the others by a shuffle.  The texts are shuffled once, into a
table with as many buckets as the session has shuffle partitions, and read from it whenever they are needed.

Null text has no words and stays null.  Texts without a repeat, shorter than ``LEAST`` words or empty ones, keep
their words.  What stays of a text is its words joined by one space, also if nothing was removed.  Repeated rows, and rows with one or no doc_id,
are documents of their own, and repeat each other.  Texts of any length are read whole.  An empty table
gives an empty result.  Further columns pass through, but for those that the operator adds.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import tables, with_group, written
from sluicework.llm.word_hashes import mix, text_bytes, word_hashes
from sluicework.session import fresh_path, remove

#: Words of the shortest repeat, and of a seed.
LEAST, SEED = 35, 12
#: Windows whose anchors are found at a time.
STRIP = 1 << 16

ALPHABET = np.arange(256).astype("uint8") + np.uint8(1)
ALPHABET[255] = 0xFF  # no byte of UTF-8
ALPHABET[[0x20, *range(0x09, 0x0E)]] = 0
_STEP = np.uint64(0xD1342543DE82EF95)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def runs(word: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words: a polynomial, put together from runs of powers of two."""
    whole, have, double, size = None, 0, word, 1
    left = width
    while left:
        if left & 1:
            if whole is None:
                whole, have = double, size
            else:
                n = len(word) - have - size + 1
                whole, have = whole[:n] + double[have:have + n] * _power(have), have + size
        left >>= 1
        if left:
            n = len(word) - 2 * size + 1
            double, size = double[:max(n, 0)] + double[size:size + max(n, 0)] * _power(size), 2 * size
    return whole


def anchors(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors' places in order: text, start of the span, number of windows, words before the anchor, hashes of
    the anchor and of the span.  ``first`` has the first word of each text, and the number of words."""
    none = np.empty(0, "int64")
    if len(word) < LEAST:
        return none, none, none, none, none.view("uint64"), none.view("uint64")
    seed, window = mix(runs(word, SEED)), runs(word, LEAST)
    wide = LEAST - SEED + 1
    at = np.empty(len(window), "int64")
    for low in range(0, len(window), STRIP):
        part = seed[low:low + STRIP + wide - 1]
        found = np.lib.stride_tricks.sliding_window_view(part, wide).argmin(axis=1)
        at[low:low + len(found)] = found + np.arange(low, low + len(found))
    text = np.searchsorted(first, np.arange(len(window)), side="right") - 1
    whole = np.flatnonzero(np.arange(len(window)) + LEAST <= first[1:][text])  # windows that lie in one text
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) != 1) | (np.diff(at[whole]) != 0)
    begin = whole[new]
    end = whole[np.append(np.flatnonzero(new)[1:], len(whole)) - 1] if len(whole) else none
    span = mix(window[begin] + mix(window[end]))
    return text[begin], begin - first[text[begin]], end - begin + 1, at[begin] - begin, seed[at[begin]], span


def places(docs: DataFrame) -> DataFrame:
    """The anchors of all texts (row, text): anchor, span, n, off, row, start."""

    def found(batches):
        for batch in batches:
            word, first = word_hashes(*text_bytes(batch.column("text")), ALPHABET)
            text, start, n, off, anchor, span = anchors(word, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view("int64")), pa.array(span.view("int64")), pa.array(n.astype("int16")), pa.array(off.astype("int16")),
                 batch.column("row").take(pa.array(text)), pa.array(start.astype("int32"))],
                names=["anchor", "span", "n", "off", "row", "start"])

    return docs.select("row", "text").mapInArrow(found, "anchor bigint, span bigint, n short, off short, row bigint, start int")


def windows(docs: DataFrame) -> DataFrame:
    """The windows of the spans ``wanted`` of all texts (row, text, wanted): anchor, window, row, start."""

    def found(batches):
        for batch in batches:
            word, first = word_hashes(*text_bytes(batch.column("text")), ALPHABET)
            wanted = batch.column("wanted")
            of = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
            start, n, anchor = (wanted.flatten().field(k).to_numpy() for k in range(3))
            n = n.astype("int64")
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(start, n) + step
            of = np.repeat(of, n)
            value = mix(runs(word, LEAST)[first[of] + start]) if len(of) else np.empty(0, "uint64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(anchor, n)), pa.array(value.view("int64")), batch.column("row").take(pa.array(of)),
                 pa.array(start.astype("int32"))], names=["anchor", "window", "row", "start"])

    return docs.select("row", "text", "wanted").mapInArrow(found, "anchor bigint, window bigint, row bigint, start int")


def repeats(docs: DataFrame, table) -> DataFrame:
    """What lies in repeats of the texts (row, text): row, start (a word's number), length (in words), maybe overlapping."""
    shared = table(with_group(table(places(docs)), "anchor", least=2).drop("_n"))
    shared = shared.withColumn("same", F.xxhash64("anchor", "span", "n", "off"))
    # Of equal spans only the first is extended further; it stands for the others, too.
    spans = table(with_group(shared, "same", F.min(F.struct("row", "start")).alias("least")))
    whole = spans.where("_n > 1").select("row", "start", (F.col("n") + LEAST - 1).alias("length"))
    edges = with_group(spans.where(F.col("least") == F.struct("row", "start")).select("anchor", "n", "row", "start"), "anchor", least=2)
    wanted = edges.groupBy("row").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("wanted"))
    found = table(windows(docs.join(wanted, "row")))
    found = found.withColumn("both", F.xxhash64("window", "anchor"))
    alike = with_group(found, "both", least=2).select("row", "start", F.lit(LEAST).alias("length"))
    return table(whole.unionByName(alike))


def _joined(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of words that the pieces cover."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        low, high = int(starts[k]), int(starts[k]) + int(lengths[k])
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


CUT = "text string, n_words bigint, n_removed bigint, repeats array<struct<start:int, length:int>>"


def _cut(text: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    rows = []
    for whole, start, length in zip(text, starts, lengths, strict=True):
        if whole is None:
            rows.append((None, 0, 0, []))
            continue
        words = whole.encode().split()  # bytes split at exactly the six ASCII spaces
        gone = _joined(start, length) if start is not None else []
        if gone:
            stays = np.ones(len(words), bool)
            for low, high in gone:
                stays[low:high] = False
            kept = list(compress(words, stays.tolist()))
        else:
            kept = words
        rows.append((b" ".join(kept).decode(), len(words), len(words) - len(kept), [{"start": a, "length": b - a} for a, b in gone]))
    return pd.DataFrame(rows, columns=["text", "n_words", "n_removed", "repeats"])


@contextmanager
def _bucketed(rows: DataFrame):
    """The rows in a table with buckets by ``row``; joins on it leave them where they are."""
    spark = rows.sparkSession
    name, path, n = f"rows_{uuid.uuid4().hex}", fresh_path(spark, "rows"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "row").write.bucketBy(n, "row").sortBy("row").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


ADDED = ["n_words", "n_removed", "repeats"]


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The rows with the text that stays, and n_words, n_removed and the maximal repeats (start, length in words)."""
    columns = [c for c in docs.columns if c not in ADDED]
    numbered = docs.select(F.struct(*columns).alias("_r"), F.monotonically_increasing_id().alias("row")).withColumn("text", F.col("_r.text"))
    numbered = numbered.withColumn("_r", F.col("_r").dropFields("text") if len(columns) > 1 else F.lit(0))
    with _bucketed(numbered) as rows, tables(docs.sparkSession) as table:
        pieces = repeats(rows.select("row", "text"), table).groupBy("row").agg(
            F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
        cut = rows.join(pieces, "row", "left").withColumn("_c", F.pandas_udf(_cut, CUT)("text", "starts", "lengths"))
        return written(cut.select(
            *[(F.col("_c.text") if c == "text" else F.col("_r").getField(c)).alias(c) for c in columns],
            *[F.col(f"_c.{c}").alias(c) for c in ADDED]))
