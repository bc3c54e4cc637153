"""SentencePiece encoding and decoding by a forward pass over a trie of the distinct words.

A text is cut into marked words (a word with the marks of the spaces before it).  The
distinct words of some texts are sorted, which is the depth-first order of their trie, and
each goes on from the forward states of the prefix it shares with the one before.  The
state of a prefix names the last piece of its best segmentation, and a word's pieces
follow by going back along the states.

The model at hand is a byte-pair model: the segmentation that counts is the one its merges
give, not the one with the largest sum of scores.  That one has the property that a prefix
plus a piece is the segmentation of the longer prefix just when the prefix' last piece and
the new piece keep apart in a text of the two alone.  Exactly one piece does at each
position, so the forward pass decides by that test, which is remembered for each pair.

Null gives null ids and null text, empty text no ids.  Characters that the model doesn't
have become bytes.  Repeated rows are encoded each; further columns pass through, but for those that have the
names of the new ones, which are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sluicework.llm.packing import chunks

MARK = "▁"
#: States of the forward pass: the empty prefix, and one that ends with a character the model doesn't have.
START, UNKNOWN = -1, -2
#: Words, in either of two generations, and pairs of pieces that a Python worker remembers.
REMEMBERED_WORDS = 60_000
REMEMBERED_PAIRS = 300_000
#: Rows of a batch that are worked on at a time.
ROWS = 500


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        self.texts = [file.id_to_piece(i) for i in range(n)]
        self.scores = [file.get_score(i) for i in range(n)]
        normal = [not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i)) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.texts) if normal[i]}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [t.replace(MARK, " ").encode() if normal[i] else b"" for i, t in enumerate(self.texts)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.sizes = [len(t) for t in self.texts]
        self.raw = [i.to_bytes(4, "little") for i in range(n)]
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int | str]:
        """The segmentation by merges: best score first, then leftmost. Unknown characters stay."""
        parts: list[str] = [*text]
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        open_: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                k = self.ids.get(both := parts[i] + parts[after[i]])
                if k is not None:
                    heapq.heappush(open_, (-self.scores[k], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while open_:
            _, i, both = heapq.heappop(open_)
            j = after[i]
            if not parts[i] or j == len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ids.get(p, p) for p in parts if p]

    def keep_apart(self, left: int, right: int) -> bool:
        """Whether the two pieces are the segmentation of their texts together."""
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= REMEMBERED_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self.merged(self.texts[left] + self.texts[right]) == [left, right]
        return known

    def segment(self, words: list[str]) -> list[bytes]:
        """The ids, as bytes, of sorted distinct marked words."""
        ids_of, known, sizes, raw = self.ids.get, self.apart, self.sizes, self.raw
        out, before, states = [], "", [START]  # states[d]: last piece of the prefix of d characters
        for word in words:
            if word.startswith(MARK * 2):
                # runs of marks have pieces with one and the same score; they are rare
                out.append(self.packed(self.merged(word)))
                continue
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                    piece = ids_of(word[start:end])
                    if piece is None:
                        continue
                    last = states[start]
                    if last < 0 or known.get(last << 32 | piece) or self.keep_apart(last, piece):
                        states.append(piece)
                        break
                else:
                    states.append(UNKNOWN)
            before, at, ids = word, len(word), []
            while at:
                piece = states[at]
                if piece == UNKNOWN:
                    ids.append(self.packed([word[at - 1]]))
                    at -= 1
                else:
                    ids.append(raw[piece])
                    at -= sizes[piece]
            ids.reverse()
            out.append(b"".join(ids))
        return out

    def packed(self, ids: list[int | str]) -> bytes:
        """Ids as bytes; a character stands for its bytes."""
        flat: list[int] = []
        for i in ids:
            if isinstance(i, str):
                flat += [self.byte_ids[b] for b in i.encode("utf-8", "surrogatepass")]
            else:
                flat.append(i)
        return b"".join([self.raw[i] for i in flat])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split = [_marked(t) for t in texts]
        if len(self.words) > REMEMBERED_WORDS:  # words that come again soon stay known
            self.words, self.older = {}, self.words
        new = {w for words in split for w in words}.difference(self.words)
        old = {w: x for w in new if (x := self.older.get(w)) is not None}
        self.words.update(old)
        ordered = sorted(new.difference(old))
        self.words.update(zip(ordered, self.segment(ordered), strict=True))
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of some ids; bytes that are no text become replacement characters."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


def _marked(text: str) -> list[str]:
    """The marked words of a text, which is given one more mark at its start."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    out, marks = [], ""
    for word in text.split(" "):
        if word:
            out.append(f"{marks}{MARK}{word}")
            marks = ""
        else:
            marks += MARK
    return [*out, marks] if marks else out


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The model, read once per Python worker."""
    return Model(path)


def _slices(batches):
    """Batches of fewer rows, so that a worker's memory doesn't go by the cluster's size of batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The rows with ``ids`` (array of int) and ``ids_crc32`` (of the ids as unsigned little-endian 32-bit numbers)."""

    docs = docs.drop("ids", "ids_crc32")

    def coded(batches):
        m = model(path)
        for batch in _slices(batches):
            texts, at = batch.column("text").to_pylist(), 0
            for part in chunks(texts):
                out = m.encode(part)
                flat = np.frombuffer(b"".join(out), "<u4").astype("int32")
                offsets = np.cumsum([0, *[len(x) // 4 for x in out]]).astype("int32")
                nulls = np.array([t is None for t in texts[at:at + len(part)]])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(nulls))
                crc = pa.array([zlib.crc32(x) for x in out], pa.int64(), mask=nulls)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(part)).columns, lists, crc], names=[*batch.schema.names, "ids", "ids_crc32"])
                at += len(part)

    kinds = StructType([*docs.schema, StructField("ids", ArrayType(IntegerType())), StructField("ids_crc32", LongType())])
    return docs.mapInArrow(coded, kinds)


def decode(rows: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """The rows with the text of their ``ids``."""

    rows = rows.drop(to)

    def spelt(batches):
        m = model(path)
        for batch in _slices(batches):
            column = batch.column("ids")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [None if not ok else m.decode(flat[a:b].tolist())
                     for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(spelt, StructType([*rows.schema, StructField(to, StringType())]))
