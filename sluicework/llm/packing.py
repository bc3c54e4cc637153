"""Best-fit packing of tokenised documents by exact-complement hashing.

A document's token ids and an end mark make its pieces: all of at most ``size`` ids, where
only a longer document is cut, and then into full pieces after a shorter first one.  How
many pieces there are of each length, at most ``size`` numbers, is all that packing needs
to know.  For the longest open length, an index of sums over the available lengths names a
single length, a pair or a triple that fills the gap exactly; the combination is used as
often as there are pieces for it.  What has no exact complement is packed by best fit,
longest first.  The plan says, for the k-th piece of each length, its sequence and offset;
pieces are numbered in parallel and look their place up by binary search.

Null text counts as empty; an empty document is the end mark alone.  Repeated rows are
documents of their own.  Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.common import written

SIZE = 1024
END_ID = 2
#: Pieces of one length that one task numbers.
NUMBERED_TOGETHER = 1_000
#: Characters of text that are worked on at a time.
CHUNK_CHARS = 1_000_000
#: Characters that make a word, or a run of white space, very long.
LONG_WORD = 500
# Fixed value: the pattern that cuts texts into words for this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of texts as bytes, four per id.

    Ordinary texts go through a second library with the same vocabulary as ranks, which
    gives the same ids several times faster.  Texts that hold the text of a special token,
    and those with very long words, for which it takes quadratic time, go through the first.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer as Public

        self.public = Public.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=pairs, special_tokens={})
        self.special = [t.content for t in self.public.get_added_tokens_decoder().values()]

    def _slow(self, text: str) -> bool:
        """Whether the text is one for the first library."""
        if any(t in text for t in self.special):
            return True
        lengths = [*map(len, text.split())]
        return max(lengths, default=0) >= LONG_WORD or (
            len(text) - sum(lengths) >= LONG_WORD and re.search(rf"\s{{{LONG_WORD}}}", text) is not None)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [
            np.asarray(self.public.encode(t, add_special_tokens=False).ids if self._slow(t)
                       else self.fast.encode_ordinary(t), "<u4").tobytes()
            for t in texts]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, ranks: str) -> Tokenizer:
    """The tokenizer, read once per Python worker."""
    return Tokenizer(vocabulary, ranks)


def chunks(texts, limit: int = CHUNK_CHARS):
    """Lists of following texts of about so many characters together."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, vocabulary: str, ranks: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        encode, end = tokenizer(vocabulary, ranks), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, done = batch.column(0), 0
            for texts in chunks(batch.column(1).to_pylist()):
                rows = []
                for k, coded in enumerate(encode(texts)):
                    coded = memoryview(coded + end)
                    n = len(coded) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    rows += [(done + k, p, a, b - a, zlib.crc32(coded[4 * a:4 * b]))
                             for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                done += len(texts)
                at, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; the work doesn't depend on the counts.

    Exact fills can use up small pieces that gaps would need later on, so that best fit alone is tried too,
    and the plan with fewer sequences holds.
    """
    return min(exact_fit(counts, size), best_fit(counts, size), key=lambda made: sum(times for _, times in made))


def exact_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Combinations that fill a sequence exactly, as often as pieces last, then best fit."""
    left = {n: c for n, c in counts.items() if c}
    made: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> bool:
        """Take the pattern as often as its pieces last."""
        need = {n: pattern.count(n) for n in pattern}
        times = min(left.get(n, 0) // k for n, k in need.items())
        if not times:
            return False
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        made.append((pattern, times))
        return True

    if left.get(size):
        use((size,))
    # Sums of two lengths that are there, by their sum; counts are looked up when they are used.
    lengths = sorted(left, reverse=True)
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            if a + b <= size:
                pairs[a + b].append((a, b))
    for top in lengths:
        gap = size - top
        while left.get(top) and use((top, gap)):
            pass
        for a, b in pairs[gap]:
            if not left.get(top):
                break
            while use((top, a, b)):
                pass
        for a in lengths:  # the longest member of a triple first
            if a > gap:
                continue
            if not left.get(top):
                break
            if left.get(a):
                for b, c in pairs[gap - a]:
                    if not (left.get(top) and left.get(a)):
                        break
                    while b <= a and use((top, a, b, c)):
                        pass
    return made + best_fit(left, size)


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the open sequence with the smallest gap that takes it; like sequences go together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = size - sum(pattern)
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append((pattern, times))

    for n in sorted(counts, reverse=True):
        count = counts[n]
        while count:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = size // n
                if count >= each:
                    put((n,) * each, count // each)
                    count %= each
                if count:
                    put((n,) * count, 1)
                break
            pattern, times = open_[gaps[at]].pop()
            if not open_[gaps[at]]:
                gaps.pop(at)
            taken = min(times, count)
            count -= taken
            if times > taken:
                put(pattern, times - taken)
            put((*pattern, n), taken)
    return [x for group in open_.values() for x in group]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, ordered by the first number that a row is for: number, sequence, offset."""
    used, found, sequence = defaultdict(int), defaultdict(list), 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            found[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: np.asarray(rows, "int64") for n, rows in found.items()}


def numbered(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """The pieces with their number among those of their length, from 0; a frequent length is dealt to many tasks, by row."""
    parts = rows.sparkSession.createDataFrame(
        [(n, -(-c // NUMBERED_TOGETHER)) for n, c in counts.items()], "length bigint, _parts int")
    rows = rows.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "_part").count().select(
        "length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "_row")
    return rows.withColumn("_own", F.row_number().over(own) - 1).join(offsets, ["length", "_part"]).withColumn(
        "_number", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def best_fit_packing(docs: DataFrame, vocabulary: str, ranks: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, vocabulary, ranks, size, end_id).withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    found = cut.sparkSession.sparkContext.broadcast(places(plan(counts, size)))

    def placed(batches):
        for batch in batches:
            n, number = batch["length"].to_numpy(), batch["_number"].to_numpy()
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for length in np.unique(n):
                mine, rows = n == length, found.value[int(length)]
                row = rows[np.searchsorted(rows[:, 0], number[mine], "right") - 1]
                sequence[mine] = row[:, 1] + number[mine] - row[:, 0]
                offset[mine] = row[:, 2]
            yield batch.drop(columns="_number").assign(sequence_id=sequence, offset=offset)

    rows = numbered(cut, counts).drop("_row").select(*[c for c in cut.columns if c != "_row"], "_number")
    kind = cut.schema["doc_id"].dataType.simpleString()
    # pandas has no null for whole numbers: ids go through as text
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        placed, "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
