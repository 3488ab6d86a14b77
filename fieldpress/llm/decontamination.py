"""Benchmark decontamination by winnowing.

Words of documents and benchmark items are hashed; both are fingerprinted by the minimum k-gram hash
of each sliding window. Two texts that share a run of `k + w - 1` words share that run's fingerprint,
so with k + w - 1 = 10 no shared ten-word window is missed; an item of m < 10 words is one window and
gets a scheme with k + w - 1 = m of its own, one per length that occurs. Documents' fingerprints are
joined to the benchmark's; each hit is extended to the window of the run, whose full hash decides.

The benchmark's fingerprints and windows are one block of sorted arrays, broadcast where they
have at most `BLOCK_WINDOWS` windows. A larger benchmark makes several blocks; documents pass through
one join after another within the same stage, each adding its hits, so the bound holds for any
benchmark and no document is shuffled. Items are read to the driver block by block.

Defined cases: a null or empty text, of a document or an item, has no words and no hits; repeated
documents get a row each; repeated items of one item_id count once; an empty benchmark hits nothing;
an empty table gives no rows; extra columns are ignored, or kept by `mark`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpress.llm.bytewords import ALNUM, Words, grams, mix, randoms
from fieldpress.llm.shared import bounded_batches, col, slices, texts_of

WINDOW = 10
#: Windows in a broadcast block: 32 bytes each, 32 MB at most.
BLOCK_WINDOWS = 1 << 20


def scheme(n: int) -> tuple[int, int]:
    """k-gram size and window width that guarantee a fingerprint in any n shared words."""
    k = (n + 1) // 2
    return k, n - k + 1


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w k-gram hashes."""
    if len(g) < w:
        return np.zeros(0, np.uint64)
    low = g[: len(g) - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, g[i : len(g) - w + 1 + i], out=low)
    return low


class Block:
    """Fingerprints and windows of some items: per window length sorted hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.items)}
        for n in sorted({min(window, len(h)) for _, h in items if len(h)}):
            k, w = scheme(n)
            prints, wins, owners = [], [], []
            for item, h in items:
                if min(window, len(h)) == n:
                    prints.append(winnow(grams(h, k), w))
                    wins.append(grams(h, n))
                    owners.append(np.full(len(wins[-1]), number[item], np.int32))
            pairs = np.unique(np.rec.fromarrays((np.concatenate(wins), np.concatenate(owners))))
            hashes, first = np.unique(pairs["f0"], return_index=True)
            self.parts[n] = (np.unique(np.concatenate(prints)), hashes, np.append(first, len(pairs)), pairs["f1"].copy())


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def hits(words: Words, block: Block) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which words are hit, and (text, item number) of items that occur, for a slice of texts."""
    hit = np.zeros(len(words.hash) + 1, np.int32)
    found: list[tuple[int, int]] = []
    for n, (prints, windows, first, owners) in block.parts.items():
        k, w = scheme(n)
        low = winnow(grams(words.hash, k), w)  # low[i] is the fingerprint of words i to i + n
        if not len(low):
            continue
        runs = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        lens = np.diff(np.append(runs, len(low)))
        good = member(prints, low[runs])
        runs, lens = runs[good], lens[good]
        starts = np.repeat(runs - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        text = np.searchsorted(words.bounds, starts, "right") - 1
        inside = starts + n <= words.bounds[text + 1]
        starts, text = starts[inside], text[inside]
        if not len(starts):
            continue
        full = _gram_at(words.hash, starts, n)
        real = member(windows, full)
        starts, text, full = starts[real], text[real], full[real]
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + n, -1)
        place = np.searchsorted(windows, full)
        pairs = np.unique(np.stack((text, place)), axis=1)
        for t, p in zip(*pairs.tolist(), strict=True):
            found += [(t, o) for o in owners[first[p] : first[p + 1]].tolist()]
    return np.cumsum(hit[:-1]) > 0, found


def _gram_at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    k = randoms(n, 100 + n)
    out = h[starts] * k[0]
    for i in range(1, n):
        out += h[starts + i] * k[i]
    return mix(out)


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of at most `most` windows; an item longer than that is cut with its windows overlapping."""
    held: list[tuple[str, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id IS NOT NULL")
    for row in rows.toLocalIterator():
        h = Words(pa.array([row.text]), ALNUM).hash
        step = max(1, most - window)
        for a in range(0, max(1, len(h) - window + 1), step):
            part = h[a : a + step + window - 1]
            if held and size + len(part) > most:
                yield Block(held, window)
                held, size = [], 0
            held.append((row.item_id, part))
            size += len(part)
    if held:
        yield Block(held, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every document with n_words, n_hit, n_items, items_sha256, contaminated and the hit spans in bytes.

    `hit_spans` lists [begin, end) byte offsets of hit runs in the UTF-8 text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = ["text", "__hit", "__items"]
    other = [c for c in keep if c not in own]
    frame = texts_of(docs, *other)
    kinds = frame.schema
    frame = frame.select(*other, "text", F.lit(None).cast("array<int>").alias("__hit"), F.lit(None).cast("array<string>").alias("__items"))
    passing = frame.schema

    def found_in(part: pa.RecordBatch, words: Words, block: Block | None) -> tuple[list[list[int]], list[list[str]]]:
        """Hit words and items of each text: earlier blocks' and this block's."""
        old_hit, old_items = col(part, "__hit").to_pylist(), col(part, "__items").to_pylist()
        named: dict[int, set[str]] = {}
        hit = np.zeros(0, bool)
        if block is not None:
            hit, found = hits(words, block)
            for t, o in found:
                named.setdefault(t, set()).add(block.items[o])
        b = words.bounds.tolist()
        own = [np.flatnonzero(hit[b[i] : b[i + 1]]).tolist() if i in named else [] for i in range(part.num_rows)]
        return [sorted({*x, *(y or ())}) for x, y in zip(own, old_hit, strict=True)], [sorted({*named.get(i, ()), *(y or ())}) for i, y in enumerate(old_items)]

    def passed(block: Block, frame: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                hit, items = found_in(part, Words(col(part, "text"), ALNUM), shared.value)
                yield pa.record_batch([*(col(part, c) for c in other), col(part, "text"), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [f.name for f in passing])

        return frame.mapInArrow(run, passing)

    last = None
    for block in blocks(benchmark, window, most):
        if last is not None:
            frame = passed(last, frame)
        last = block
    final = spark.sparkContext.broadcast(last)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(col(part, "text"), ALNUM)
            hit, items = found_in(part, words, final.value)
            spans = []
            for i, h in enumerate(hit):
                at = np.asarray(h, np.int64)
                a = int(words.bounds[i])
                runs = [x for x in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(x)]
                spans.append([int(v) for x in runs for v in (words.starts[a + x[0]] - words.text_starts[i], words.ends[a + x[-1]] - words.text_starts[i])])
            made = {
                "n_words": pa.array(np.diff(words.bounds), pa.int64()), "n_hit": pa.array([len(h) for h in hit], pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), "contaminated": pa.array([bool(h) for h in hit]), "hit_spans": pa.array(spans, pa.list_(pa.int64())),
            }
            yield pa.record_batch([*(col(part, c) for c in other if c not in made), *([col(part, "text")] if "text" in keep else []), *made.values()], [*(c for c in other if c not in made), *(["text"] if "text" in keep else []), *made])

    taken = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"}
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds if f.name in other and f.name not in taken]
    schema = ", ".join([*head, *(["text string"] if "text" in keep else []), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<long>"])
    return frame.mapInArrow(close, schema)
