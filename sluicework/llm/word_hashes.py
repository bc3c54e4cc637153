"""Words of whole batches of texts as 64-bit numbers, worked out on the UTF-8 bytes with numpy.

A word's number is a polynomial in its bytes modulo 2^64, stirred at the end.  Equal words have
equal numbers; two different words agree with a probability of about 2^-64.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at a time; a longer word is hashed by itself.
BLOCK = 1 << 19

#: Odd, and 5 modulo 8, so that its powers repeat only after 2^62 steps.
BASE = 0x9E3779B97F4A7C15
_SIZE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Stirs the bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse."""
    def powers(base: int) -> np.ndarray:
        rising = np.full(BLOCK + 1, base % (1 << 64), "uint64")
        rising[0] = 1
        return np.multiply.accumulate(rising)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null is empty."""
    whole = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    places = np.frombuffer(offsets, "int64")[whole.offset:whole.offset + len(whole) + 1]
    first, last = int(places[0]), int(places[-1])
    values = np.frombuffer(data, "uint8")[first:last] if data is not None else np.empty(0, "uint8")
    return values, places - first


def word_hashes(data: np.ndarray, places: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words in order, and which of them begins each text.

    ``alphabet`` has 256 entries: 0 for a byte between words, else the byte to hash for it.
    """
    inside = alphabet[data] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = places[(places > 0) & (places < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers()
    found = np.empty(len(start), "uint64")
    at = 0
    while at < len(start):
        low = start[at]
        to = int(np.searchsorted(end, low + BLOCK, side="right"))
        if to == at:
            text = alphabet[data[low:end[at]]].tobytes()
            found[at] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
            at += 1
            continue
        part = alphabet[data[low:end[to - 1]]].astype("uint64")
        sums = np.zeros(len(part) + 1, "uint64")
        np.cumsum(part * up[:len(part)], out=sums[1:])
        a, b = start[at:to] - low, end[at:to] - low
        found[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype("uint64") * _SIZE)
        at = to
    return found, np.searchsorted(start, places)
