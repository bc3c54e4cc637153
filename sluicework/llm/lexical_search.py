"""Ranked lexical search with hashed max-sketches.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A to Z are
lower-cased.  A document's score for a query is the sum, over the query's terms with repeats, of
``w * ((10^9 * tf) div (1000 * tf + 8 * m))``, where ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 25 + (75 * n * N) div L``; N counts the documents with a term, L all their terms, n those of the
document, tf and df are as usual.

The queries are a stated set and go in blocks of ``BLOCK`` against all documents.  For each block:

1. One pass over the texts gives each document's n and the tf of the block's terms.  Terms that
   no query of the block has take part in n, N and L only, since nothing ever looks them up.
   The rows are written: a document with none of the terms is a row of three numbers.
2. N, L and the df are sums over these rows.
3. A document's impacts (its terms' summands) fold into a sketch of ``WIDTH`` numbers: a term's
   hash names a place, and each place keeps the largest impact.  For a batch of documents
   and all queries of the block at once, the sums of the places of the query's terms are upper bounds
   of the scores, found as one product of matrices.
4. A task rescores the documents of each query exactly by descending bound, until the bound falls below
   the k-th best score so far.  All sums are integers below 2^53, so bounds are exact in doubles.
5. Each task gives at most k rows per query; a rank over these gives the result.

What is broadcast is a block of queries and the df of its terms: at most ``BLOCK`` queries with at
most ``BLOCK_TERMS`` terms together (one query of any length makes a block of its own).

Null and empty texts have no terms and are never found; a query without terms finds nothing.  Every
row is a document, and every row of the queries a query, also if they repeat.  Equal scores go by ascending
doc_id, a null one last, then by row.  Texts of any length are read whole.  Empty tables give an
empty result.  Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.common import tables, written
from sluicework.llm.word_hashes import text_bytes, word_hashes

#: Queries of a block, and their different terms.
BLOCK, BLOCK_TERMS = 1_000, 50_000
#: Numbers of a sketch.
WIDTH = 1_024
#: Parts in which what the tasks found for a query is ranked first.
PARTS = 64
#: Documents that get their bounds together.
TOGETHER = 500

ALPHABET = np.zeros(256, "uint8")
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    ALPHABET[_c] = _c
ALPHABET[ord("A"):ord("Z") + 1] = ALPHABET[ord("a"):ord("z") + 1]
ALPHABET[128:] = np.arange(128, 256)


def query_blocks(queries: DataFrame) -> Iterator[pd.DataFrame]:
    """Blocks of queries (query, text) as (query, term, times), read one after the other, in the order of ``query``."""
    held, kinds = [], set()
    for number, text in queries.select("query", "text").orderBy("query").toLocalIterator():
        terms, times = np.unique(word_hashes(*text_bytes(pa.array([text], pa.string())), ALPHABET)[0], return_counts=True)
        if held and (len(held) >= BLOCK or len(kinds.union(terms.tolist())) > BLOCK_TERMS):
            yield pd.concat(held, ignore_index=True)
            held, kinds = [], set()
        if len(terms):
            held.append(pd.DataFrame({"query": number, "term": terms, "times": times}))
            kinds.update(terms.tolist())
    if held:
        yield pd.concat(held, ignore_index=True)


def postings(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Per row (doc_id, text) with a term: its number of terms, and place among the known terms and tf of those that it has."""

    def counted(batches):
        for batch in batches:
            found, first = word_hashes(*text_bytes(batch.column("text")), ALPHABET)
            size = np.diff(first)
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[place] == found
            of = np.repeat(np.arange(len(size)), size)[hit]
            pairs, tf = np.unique(of * len(known) + place[hit], return_counts=True)
            full = size > 0
            ends = np.searchsorted(pairs, np.append(np.flatnonzero(full), len(size)) * len(known)).astype("int32")
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype("int32")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).filter(pa.array(full)) for c in ("row", "doc_id")], pa.array(size[full].astype("int64")),
                 lists(pairs % len(known)), lists(tf)], names=["row", "doc_id", "n", "terms", "tf"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(counted, "row bigint, doc_id bigint, n bigint, terms array<int>, tf array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The weight of terms that so many documents hold."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype("int64")


class Block:
    """The queries of a block, and the weights and places of their terms."""

    def __init__(self, queries: pd.DataFrame, known: np.ndarray, weight: np.ndarray, top: int):
        self.ids = queries["query"].drop_duplicates().to_numpy()
        self.weight, self.top = weight, top
        self.place = (known % np.uint64(WIDTH)).astype("int64")
        number = np.searchsorted(self.ids, queries["query"].to_numpy())
        term, times = np.searchsorted(known, queries["term"].to_numpy()), queries["times"].to_numpy()
        self.times = np.zeros((len(self.ids), WIDTH))
        np.add.at(self.times, (number, self.place[term]), times)
        self.terms = [dict(zip(term[number == k].tolist(), times[number == k].tolist(), strict=True)) for k in range(len(self.ids))]
        self.best: list[list[tuple]] = [[] for _ in self.ids]  # of each query (-score, has no doc_id, doc_id, row), best first

    def offer(self, docs: pd.DataFrame, n_docs: int, n_terms: int) -> None:
        """Take the documents into account that may be among the best of a query."""
        sizes = docs["terms"].map(len).to_numpy()
        of = np.repeat(np.arange(len(docs)), sizes)
        term, tf = (np.concatenate([np.empty(0, "int64"), *docs[c]]).astype("int64") for c in ("terms", "tf"))
        m = np.array([25 + 75 * int(n) * n_docs // n_terms for n in docs["n"]], "int64")
        impact = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
        sketch = np.zeros((len(docs), WIDTH))
        np.maximum.at(sketch, (of, self.place[term]), impact)
        bounds = sketch @ self.times.T
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids, rows = docs["doc_id"].tolist(), docs["row"].tolist()
        exact: dict[int, dict] = {}
        for k, best in enumerate(self.best):
            least = -best[-1][0] if len(best) == self.top else 1
            able = np.flatnonzero(bounds[:, k] >= least)
            for d in able[np.argsort(-bounds[able, k], kind="stable")].tolist():
                if bounds[d, k] < (-best[-1][0] if len(best) == self.top else 1):
                    break
                if d not in exact:
                    own = slice(first[d], first[d + 1])
                    exact[d] = dict(zip(term[own].tolist(), impact[own].tolist(), strict=True))
                have = exact[d]
                score = sum(have[t] * c for t, c in self.terms[k].items() if t in have)
                if score > 0:
                    none = ids[d] is None or ids[d] != ids[d]
                    best.append((-score, none, 0 if none else int(ids[d]), rows[d]))
                    best.sort()
                    del best[self.top:]

    def result(self) -> pd.DataFrame:
        found = [(q, None if none else d, row, -s) for q, best in zip(self.ids.tolist(), self.best, strict=True) for s, none, d, row in best]
        return pd.DataFrame(found, columns=["query", "doc_id", "row", "score"]).astype({"doc_id": "Int64"})


def _best_of_tasks(docs: DataFrame, queries: pd.DataFrame, top: int, table) -> DataFrame:
    """Of each query and task at most ``top`` rows (query, doc_id, row, score)."""
    known = np.unique(queries["term"].to_numpy())
    held = table(postings(docs, known))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row per known term
    df = np.zeros(len(known), "int64")
    for term, count in counted:
        df[term] = count
    shared = docs.sparkSession.sparkContext.broadcast((queries, known, weights(df, n_docs), top))

    def ranked(batches):
        block = Block(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                block.offer(batch.iloc[at:at + TOGETHER], n_docs, n_terms)
        yield block.result()

    return table(held.mapInPandas(ranked, "query bigint, doc_id bigint, row bigint, score bigint"))


def lexical_search(docs: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) of each query (item_id, text)."""
    with tables(docs.sparkSession) as table:
        asked = table(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"))
        found = docs.sparkSession.createDataFrame([], "query bigint, doc_id bigint, row bigint, score bigint")
        for block in query_blocks(asked):
            found = found.unionByName(_best_of_tasks(docs, block, top, table))
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
        for keys in (["query", "part"], ["query"]):  # first in parts, so that no task ranks what all tasks found for a query
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            found = found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS))).withColumn("rank", rank).where(F.col("rank") <= top)
        return written(found.join(asked.drop("text"), "query").select("item_id", "rank", "doc_id", "score"))
