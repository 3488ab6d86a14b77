"""Tokenisation by distinct pre-tokens: cut texts where no token can cross, encode each distinct piece of text once.

Cuts are found by byte rules that hold for the tokenizer at hand (`Cutter`), pieces are told apart
by a 64-bit hash, and what the library says of a piece is kept in a bounded cache of the worker.
Texts or vocabularies for which no rule is proven are encoded whole by the library itself.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa

from fieldpress.llm.bytewords import hashed, joined

#: Distinct pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 1_500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_GRAPH = np.zeros(256, bool)
_GRAPH[range(0x21, 0x7F)] = True


def _after_wide(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of positions after a byte of a multi-byte character, whether that character is surely no white space."""
    one, two, three, four = (buf[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
    pair = (two >= 0xC3) & (two <= 0xDF)
    triple = (three >= 0xE0) & (three <= 0xEF) & (two >= 0x80) & (two < 0xC0) & (three != 0xE1) & (three != 0xE2) & ~((three == 0xE3) & (two == 0x80))
    return (one >= 0x80) & (pair | triple | (four >= 0xF0))


def cuts_byte_bpe(buf: np.ndarray) -> np.ndarray:
    """Where a byte-level BPE pre-token surely begins: after a letter before ASCII that is none, and after visible characters before white space."""
    now, before = buf[1:], buf[:-1]
    cut = np.zeros(len(buf), bool)
    latin = np.zeros(len(buf), bool)  # ends a letter of U+00C0-U+00FF
    latin[1:] = (before == 0xC3) & (now != 0x97) & (now != 0xB7) & (now >= 0x80)
    letter = _LETTER[buf] | latin
    cut[1:] = (letter[:-1] & (now < 0x80) & ~_LETTER[now]) | (_GRAPH[before] & _SPACE[now])
    at = np.flatnonzero(_SPACE[now] & (before >= 0x80) & ~cut[1:]) + 1
    cut[at] = _after_wide(buf, at)
    return cut


def cuts_piece_bpe(buf: np.ndarray) -> np.ndarray:
    """Where a piece of a whitespace-escaping BPE begins: before each line feed, and before the first space of a run."""
    now, before = buf[1:], buf[:-1]
    cut = np.zeros(len(buf), bool)
    cut[1:] = ((now == 0x20) & (before != 0x20)) | (now == 0x0A)
    if len(buf) > 3:  # the escape sign itself, U+2581, in a text may join the space after it
        at = np.flatnonzero((buf[:-3] == 0xE2) & (buf[1:-2] == 0x96) & (buf[2:-1] == 0x81) & (buf[3:] == 0x20)) + 3
        cut[at] = False
    return cut


class Encoder:
    """One vocabulary in one worker. `spans` cuts a slice of texts, `ids` and `counts` encode it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.special, self.cutter = path, [], None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            spec = json.loads(self.lib.to_str())
            pre = spec.get("pre_tokenizer") or {}
            plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("truncation") and not spec.get("padding")
            self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
            self.cutter = cuts_byte_bpe if plain and spec["model"]["type"] == "BPE" else None
            self.size, self.firsts = self.lib.get_vocab_size(), False
        else:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.firsts = self.lib.get_piece_size(), True
            pieces = [self.lib.id_to_piece(i) for i in range(self.size)]
            apart = not any("\n" in p or " " in p or "▁" in p.lstrip("▁") for p in pieces)
            probe = [self.lib.encode(x, out_type=str) for x in (" a", "a  ", "\na", "")]  # no white space is dropped, a prefix is set
            ours = ["".join(p) for p in probe] == ["▁▁a", "▁a▁▁", "▁<0x0A>a", ""] and probe[2][0] == "▁"
            self.cutter = cuts_piece_bpe if apart and ours else None
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.dtype)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """What the library gives for whole texts."""
        if self.firsts:
            return self.lib.encode(texts, num_threads=1)
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, texts: list[str], first: list[bool]) -> list[list[int]]:
        """The ids of pieces of text that stand within a text, or at its beginning."""
        if not self.firsts:
            return self.whole(texts)
        blank = self.lib.piece_to_id("▁")
        shaped = [t[1:] if not f and t[0] == " " else t for t, f in zip(texts, first, strict=True)]
        return [[blank] if not s and not f else e[1:] if not f and t[0] == "\n" else e for s, t, f, e in zip(shaped, texts, first, self.lib.encode(shaped, num_threads=1), strict=True)]

    def _find(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places in the cache of distinct, sorted keys; what is missing is encoded."""
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if (new := np.flatnonzero(~known)).size:
            raw = buf.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            found = self._parts(texts, first[new].tolist())
            lens = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(lens.sum()))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens))
            self.lens, self.flat, self.keys = np.concatenate((self.lens, lens)), np.concatenate((self.flat, flat)), np.concatenate((self.keys, keys[new]))
            order = np.argsort(self.keys)
            self.keys, self.starts, self.lens = self.keys[order], self.starts[order], self.lens[order]
            at = np.searchsorted(self.keys, keys)
        return at

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per piece its place in the cache; the bounds of each text's pieces; which texts the library must take whole."""
        buf, at = joined(texts)
        whole = np.zeros(len(texts), bool)
        if self.special:
            raw = buf.tobytes()
            for s in self.special:
                k = raw.find(s)
                while k >= 0:
                    whole[i := int(np.searchsorted(at, k, "right")) - 1] = True
                    k = raw.find(s, int(at[i + 1]))
        cut = self.cutter(buf)
        cut[at[:-1]] = True
        cut[at - 1] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        gap = np.zeros(len(buf), bool)
        gap[at - 1] = True
        real = ~gap[starts]
        starts, ends = starts[real], ends[real]
        bounds = np.searchsorted(starts, at)
        key = hashed(buf, starts, ends)
        first = np.zeros(len(starts), bool)
        if self.firsts:
            first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
            key[first] ^= np.uint64(0x5851F42D4C957F2D)
        distinct, one, back = np.unique(key, return_index=True, return_inverse=True)
        return self._find(distinct, buf, starts[one], ends[one], first[one])[back], bounds, whole

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts in a row, and the bounds of each text's ids."""
        if self.cutter is None:
            return self._joined(self.whole([x or "" for x in texts.to_pylist()]))
        at, bounds, whole = self._cut(texts)
        lens = self.lens[at].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(lens)))
        flat = self.flat[np.repeat(self.starts[at] - total[:-1], lens) + np.arange(total[-1])]
        ends = total[bounds]
        if not whole.any():
            return flat, ends
        own = iter(self.whole([texts[i].as_py() for i in np.flatnonzero(whole).tolist()]))
        return self._joined([next(own) if w else flat[a:b] for w, a, b in zip(whole, ends, ends[1:], strict=False)])

    def _joined(self, each: list) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        return np.concatenate([np.zeros(0, self.dtype), *(np.asarray(x, self.dtype) for x in each)]), bounds

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text: each text's frequencies of its distinct pre-tokens, joined to the pieces of each, without the ids of any text."""
        if self.cutter is None:
            return np.array([len(x) for x in self.whole([x or "" for x in texts.to_pylist()])], np.int64)
        at, bounds, whole = self._cut(texts)
        kinds = max(1, len(self.keys))
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        pairs, frequency = np.unique(text * kinds + at, return_counts=True)
        text, token = np.divmod(pairs, kinds)
        total = np.concatenate(([0], np.cumsum(frequency * self.lens[token], dtype=np.int64)))
        n = np.diff(total[np.searchsorted(text, np.arange(len(texts) + 1))])
        if whole.any():
            n[whole] = [len(x) for x in self.whole([texts[i].as_py() for i in np.flatnonzero(whole).tolist()])]
        return n


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; reused workers keep it, with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
