"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two of them are linked if their Jaccard similarity is
at least 4/5.

1. Documents with one and the same set form a text, which is compared once.
2. Each text has 40 bands of five MinHash values.  Texts that agree in a band are
   candidates; a pair with similarity 4/5 fails to be one with probability 1.4e-7.
3. Candidates are compared on 64 further MinHash values, 16 at a time.  After each step a pair is
   dropped if, by a uniform prior, the probability that its similarity reaches 4/5 is
   below ``TOLERANCE``.  Of the pairs that are left only a spanning forest is passed on, a
   row less than there are texts in a bucket, however many pairs there are.
4. Any surviving pair lies in one component of these forests.  Within each component all
   pairs are verified exactly, block by block, on whole shingle sets.  What comes out is
   each text's number of links and a spanning forest of the links.
5. Components of the links are the classes.

A bucket or component of any size is cut into blocks of bounded size; a pair of blocks is
a task's work, and no row stands for a pair of texts.  The exact step of a component of ``n`` different texts still compares
``n * n / 2`` pairs, since that many may be links that are to be counted.

A text of one to four words is a single shingle.  Null and empty texts have none, are
linked to nothing and form no class.  Repeated rows are documents of their own.  ``keep_one``
numbers the rows, so that of each class exactly one stays, also of repeated rows and of rows without
a doc_id.  Further columns pass through it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import row_key, tables, with_group, written
from sluicework.llm.components import components

SHINGLE = 5
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 40, 5
CHECKS, STEP = 64, 16
TOLERANCE = 1e-9
#: Texts of a bucket, texts of a component and their shingles that make a block.
BUCKET_BLOCK, BLOCK, BLOCK_SHINGLES = 2_000, 1_000, 2_000_000
#: Hash functions and shingles that are worked on at a time, to stay in the processor's cache.
TILE = 66, 1_024
#: Columns of the matrix of shared shingles that are multiplied at a time.
COLUMNS = 4_096

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_N = BANDS * BAND_ROWS + CHECKS
_DRAW = np.random.Generator(np.random.PCG64(20_011))
_A = _DRAW.integers(0, 1 << 63, _N, dtype="uint64") * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, _N, dtype="uint64")
_STIR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = _WORD.findall(text or "")
    if not words:
        return np.empty(0, "uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, "uint64")
    for k in range(width):
        s = _mix(s * _STIR + h[k:k + n])
    return np.unique(s)


def minhash(s: np.ndarray) -> np.ndarray:
    """The least of each hash function over some shingles."""
    least = np.full(_N, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(s), TILE[1]):
        part = s[at:at + TILE[1]]
        values = np.empty((TILE[0], len(part)), "uint64")
        for k in range(0, _N, TILE[0]):
            rows = values[:_N - k]
            np.multiply(_A[k:k + TILE[0], None], part, out=rows)
            rows += _B[k:k + TILE[0], None]
            np.minimum(least[k:k + TILE[0]], rows.min(axis=1), out=least[k:k + TILE[0]])
    return (least >> np.uint64(32)).astype("uint32")


def band_keys(least: np.ndarray) -> np.ndarray:
    """A number for each band, other bands having other numbers."""
    rows = least[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype("uint64")
    key = np.arange(BANDS, dtype="uint64")
    for k in range(BAND_ROWS):
        key = _mix(key * _STIR + rows[:, k])
    return key.view("int64")


def signatures(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, row, text): doc_id, row, key (of its shingle set, null without shingles), n, bands, checks."""

    def signed(batches):
        for batch in batches:
            keys, sizes, bands, checks = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                least = minhash(s)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                bands.append(band_keys(least))
                checks.append(least[BANDS * BAND_ROWS:].astype("uint16").tobytes())
            offsets = pa.array(np.arange(len(keys) + 1, dtype="int32") * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands))), pa.array(checks, pa.binary())],
                names=["doc_id", "row", "key", "n", "bands", "checks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(
        signed, f"doc_id {kind}, row bigint, key binary, n bigint, bands array<bigint>, checks binary")


def needed_matches(tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After how many values how many must agree, so that similarity 4/5 is likely enough still."""
    t = SIMILARITY[0] / SIMILARITY[1]
    found = []
    for n in range(STEP, CHECKS + 1, STEP):
        below = 0.0  # the probability that a similarity with m agreements of n is at least t
        for m in range(n + 1):
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                found.append((n, m))
                break
    return found


def survivors(one: np.ndarray, others: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """The numbers of the rows that aren't dropped in the comparison with ``one``."""
    left, agree, at = np.arange(len(others)), np.zeros(len(others), "int64"), 0
    for n, m in needed:
        agree = agree + (others[left, at:n] == one[at:n]).sum(axis=1)
        left, agree, at = left[agree >= m], agree[agree >= m], n
    return left


class Sets:
    """Disjoint sets of the numbers below ``n``."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were in different sets until now."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def groups(batches, by: list[str]):
    """The rows of each group, of pandas batches that are sorted by group; one group at a time is held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        names = batch[by].astype(object).to_numpy()
        new = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1)))
        for a, b in zip(new, [*new[1:], len(batch)], strict=True):
            part = batch.iloc[a:b]
            if held and (a > 0 or tuple(held[-1][by].iloc[-1]) != tuple(names[0])):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def block_pairs(rows: DataFrame, group: str, blocks, columns: list[str]) -> DataFrame:
    """Each row once for each pair of blocks of its group that it takes part in, sorted by pair."""
    blocks = F.ceil(blocks).cast("int")
    own, other = F.pmod(F.xxhash64("key"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    return rows.select(group, own.alias("block"), *columns, other.alias("_o")).select(
        group, "block", *columns, F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j")
    ).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def candidates(texts: DataFrame, table) -> DataFrame:
    """Edges (u, v) of forests that span the pairs that pruning leaves."""
    banded = texts.select("key", F.explode("bands").alias("band"))
    shared = with_group(banded, "band", F.bit_xor(F.xxhash64("key")).alias("bucket"), least=2)
    # Buckets of the same texts are one.
    rows = table(shared.select("bucket", F.col("_n").alias("size"), "key").distinct()).join(texts.select("key", "checks"), "key")
    dealt = block_pairs(rows, "bucket", F.col("size") / BUCKET_BLOCK, ["key", "checks"])
    needed = needed_matches()

    def pruned(batches):
        for group in groups(batches, ["bucket", "i", "j"]):
            keys = group["key"].to_list()
            checks = np.frombuffer(b"".join(group["checks"]), "uint16").reshape(len(keys), CHECKS)
            sets, out = Sets(len(keys)), []
            for one in range(len(keys) - 1):
                rest = np.arange(one + 1, len(keys))
                if len(rest) > 8:  # pairs that are connected already needn't be compared
                    mine = sets.top(one)
                    rest = rest[np.fromiter((sets.top(i) != mine for i in rest), bool, len(rest))]
                for other in rest[survivors(checks[one], checks[rest], needed)]:
                    if sets.join(one, int(other)):
                        out.append((keys[one], keys[other]))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    return dealt.mapInPandas(pruned, "u binary, v binary")


def linked(sets: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
    """Which pairs of shingle sets are similar; of two blocks, only pairs across them."""
    num, den = SIMILARITY
    sizes = np.array([len(s) for s in sets])
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at, minlength=len(distinct)) > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[at]
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), "float32")  # exact up to 2^24 common shingles in a chunk
    total = np.zeros((len(sets), len(sets)), "int64")
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [a, a + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), "float32")
        part[owner[lo:hi], at[lo:hi] - a] = 1
        np.matmul(part, part.T, out=both)
        total += both.astype("int64")
    similar = (num + den) * total >= num * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(similar, False)
    return similar & (blocks[:, None] != blocks[None, :]) if blocks.min() != blocks.max() else similar


def links(members: DataFrame) -> DataFrame:
    """Rows (u, v, n): an edge of a forest that spans the links, or (v null) a number of linked documents of ``u``."""
    dealt = block_pairs(
        members, "component", F.greatest(F.col("_n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES), ["key", "size", "text"])

    def verified(batches):
        for group in groups(batches, ["component", "i", "j"]):
            keys, weight = group["key"].to_list(), group["size"].to_numpy()
            blocks = group["block"].to_numpy()
            if group["i"].iloc[0] != group["j"].iloc[0] and blocks.min() == blocks.max():
                continue
            similar = linked([shingles(t) for t in group["text"]], blocks)
            counts = similar @ weight
            out, sets = [(k, None, int(c)) for k, c in zip(keys, counts, strict=True) if c], Sets(len(keys))
            for one in range(len(keys) - 1):
                for other in np.flatnonzero(similar[one, one + 1:]) + one + 1:
                    if sets.up[other] != sets.up[one] and sets.join(one, int(other)):
                        out.append((keys[one], keys[other], 0))
            if out:
                yield pd.DataFrame(out, columns=["u", "v", "n"])

    return dealt.mapInPandas(verified, "u binary, v binary, n bigint")


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row, class_id, class_size, n_copies, n_links.

    ``class_id`` is the least doc_id of the class, ``n_copies`` counts the documents with the same
    shingles, this one too, ``n_links`` all other documents that are similar enough.
    """
    return _joined(docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")).drop("keep")


def _joined(docs: DataFrame) -> DataFrame:
    """``ngram_join`` of documents (doc_id, row, text), with the row that stays of each class, ``keep``.

    That is the least row of the least doc_id; null comes last.
    """
    with tables(docs.sparkSession) as table:
        signed = table(signatures(docs))
        texts = table(signed.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least"), F.count("*").alias("size"),
            F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("checks").alias("checks")))
        close = table(components(candidates(texts, table), table))
        wanted = with_group(
            texts.select("key", "least.row", "size", "n").join(
                close.select(F.col("node").alias("key"), F.col("label").alias("component")), "key"),
            "component", F.sum("n").alias("shingles"))
        members = docs.select("row", "text").join(wanted, "row").dropDuplicates(["key"])
        found = table(links(members))
        counts = found.where("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n_links"))
        labels = components(found.where("v IS NOT NULL").select("u", "v"), table)
        told = table(texts.select("key", "least", "size").join(labels.select(F.col("node").alias("key"), "label"), "key", "left").join(
            counts, "key", "left").withColumn("label", F.coalesce("label", "key")))
        classes = table(with_group(
            told, "label", F.min("least").alias("first"), F.sum("size").alias("class_size")).select(
            "key", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("keep"), "class_size", F.col("size").alias("n_copies"),
            (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
        rows, total = signed.select("doc_id", "row", "key"), signed.count()
        often = F.broadcast(classes.where(F.col("n_copies") >= 0.001 * total))  # at most 1000 rows
        seldom = classes.where(F.col("n_copies") < 0.001 * total)
        joined = rows.join(often, "key").unionByName(
            rows.where(F.col("key").isNotNull()).join(often.select("key"), "key", "left_anti").join(seldom, "key"))
        alone = rows.where(F.col("key").isNull()).select(
            "doc_id", "row", F.col("doc_id").alias("class_id"), F.col("row").alias("keep"), *[F.lit(n).cast("long").alias(c) for c, n in (
                ("class_size", 1), ("n_copies", 1), ("n_links", 0))])
        return written(joined.select(*alone.columns).unionByName(alone))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of each class only the first row of those with the least doc_id; null comes last."""
    # Written, so that a row keeps its number.
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("_r")))
    gone = _joined(rows.select("_r.doc_id", "row", "_r.text")).where("row <> keep").select("row")
    return rows.join(gone, "row", "left_anti").select(*[F.col("_r").getField(c).alias(c) for c in docs.columns])
