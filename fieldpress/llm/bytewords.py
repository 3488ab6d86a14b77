"""Words, shingles and their 64-bit hashes straight from UTF-8 bytes, without a Python object per word.

All word classes used here are unions of byte classes (every byte of a multi-byte character is a
word byte), so words are found by one table look-up per byte and hashed by sums over their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
NONSPACE = np.ones(256, np.uint8)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = 0
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = np.ones(256, np.uint8)
ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers of a seed."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_COEFFICIENTS = randoms(256, 11)


def coefficients(n: int) -> np.ndarray:
    global _COEFFICIENTS
    if n > len(_COEFFICIENTS):
        if n > 1 << 16:
            return randoms(n, 11)
        _COEFFICIENTS = randoms(1 << (n - 1).bit_length(), 11)
    return _COEFFICIENTS


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a space before, between and after them; where each begins, and one past the last."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = 8 if pa.types.is_large_string(texts.type) else 4
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide == 8 else np.int32, len(texts) + 1, texts.offset * wide).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    starts = offsets - offsets[0] + np.arange(len(offsets)) + 1
    out = np.full(int(starts[-1]), 32, np.uint8)
    lens = np.diff(offsets)
    for a, b, n in zip(starts.tolist(), offsets.tolist(), lens.tolist(), strict=False):
        out[a : a + n] = data[b : b + n]
    return out, starts


def spans(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; buf begins and ends with a separator. A step's temporaries are bounded, whatever the text's length."""
    at = np.concatenate([np.flatnonzero(np.diff(kind[buf[a : a + STEP + 1]].view(np.int8))) + a for a in range(0, len(buf), STEP)])
    return at[::2] + 1, at[1::2] + 1


#: Bytes, or words, of a text that one step works on.
STEP = 1 << 20
#: Spans up to this many bytes are hashed eight bytes at a time, longer ones byte by byte.
SHORT = 64
_BLOCKS = randoms(SHORT // 8, 13)


def _long_sums(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    first = np.cumsum(lens) - lens
    rank = np.arange(int(lens.sum())) - np.repeat(first, lens)
    terms = coefficients(int(lens.max()))[rank]
    terms *= buf[rank + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)
    return np.add.reduceat(terms, first)


def _hashed(wide: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    h = lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    which, at, left = np.arange(len(starts)), starts, lens
    if (long := lens > SHORT).any():
        for i in np.array_split(np.flatnonzero(long), 1 + int(lens[long].sum()) // STEP):
            if len(i):
                h[i] += _long_sums(buf, starts[i], lens[i])
        which = np.flatnonzero(~long)
        at, left = starts[which], lens[which]
    for k in _BLOCKS:
        cut = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        block = mix((wide[at].reshape(-1).view(np.uint64) << cut) * k)
        if len(which) == len(h):
            h += block
        else:
            h[which] += block
        more = left > 8
        if not more.any():
            break
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return mix(h)


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, none of them empty: a sum of its bytes or eight-byte blocks, each mixed or times a coefficient of its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    wide = np.lib.stride_tricks.as_strided(np.concatenate((buf, np.zeros(8, np.uint8))), (len(buf) + 1, 8), (1, 1))
    return np.concatenate([_hashed(wide, buf, starts[a : a + STEP], ends[a : a + STEP]) for a in range(0, len(starts), STEP)])


class Words:
    """The words of a slice of texts: hash, and `bounds[i]:bounds[i + 1]` are those of text i."""

    def __init__(self, texts: pa.Array, kind: np.ndarray = NONSPACE, lower: bool = True):
        buf, self.text_starts = joined(texts)
        self.buf = LOWER[buf] if lower else buf
        self.starts, self.ends = spans(self.buf, kind)
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.hash = hashed(self.buf, self.starts, self.ends)

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of an array of word hashes, across text borders too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    k = randoms(n, 100 + n)
    out = h[: len(h) - n + 1] * k[0]
    for i in range(1, n):
        out += h[i : len(h) - n + 1 + i] * k[i]
    return mix(out)


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct n-word shingle hashes; fewer words make one shingle, none make none."""
    runs, out = grams(words.hash, n), []
    b = words.bounds.tolist()
    for lo, hi in zip(b, b[1:], strict=False):
        if hi - lo >= n:
            s = np.sort(runs[lo : hi - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(grams(words.hash[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out
