"""Whole texts as byte arrays: slices, word bounds and word hashes over blocks of documents."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: An odd multiplier and its inverse modulo 2**64, for hashes of slices by differences of running sums.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def blocks(batch: pa.RecordBatch, column: int = 1, block_bytes: int = BLOCK_BYTES):
    """(first row, bytes, offsets) for runs of rows of about ``block_bytes``; null texts are empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def powers(n: int):
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(max(n, 2 * BLOCK_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def running(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences hash slices; one more than ``data``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words: the sum of a mixed value for each byte at its place in the word.

    Unlike a polynomial modulo a power of two, which maps long words of two letters in Thue-Morse order and their
    complements to one value, a sum of mixed values has no such words.
    """
    lengths = ends - starts
    at = np.flatnonzero(inside)
    upto = np.r_[0, np.cumsum(lengths)]
    place = np.arange(len(at)) - np.repeat(upto[:-1], lengths)
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(mix(place.astype(np.uint64) << np.uint64(8) | data[at]), dtype=np.uint64, out=sums[1:])
    return mix(sums[upto[1:]] - sums[upto[:-1]] + lengths.astype(np.uint64))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def lower_table() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower


class Words:
    """Words of a block of documents: byte bounds, a 64-bit hash each, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: np.ndarray):
        self.data = lower[data]
        inside = is_word[self.data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.hashes = word_hashes(self.data, inside, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)  # of each document's words, one more

    def shingles(self, width: int):
        """Hashes of every ``width`` neighbouring words, and which of them lie inside one document."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * np.uint64(_STEP) + self.hashes[k : k + n]
        doc_end = np.repeat(self.bounds[1:], np.diff(self.bounds))[:n]
        return mix(out), np.arange(n) + width <= doc_end
