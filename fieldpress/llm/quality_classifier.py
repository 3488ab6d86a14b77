"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every document are made once, from its bytes alone (never from labels, language, source
or id), and written; the labelled training rows among them, at most `SAMPLE` chosen by a hash of
doc_id, are fitted on the driver in numpy. Trees are complete binary trees of `DEPTH` levels, flattened
into arrays; scoring walks all trees of a batch of rows at once, a level at a time.

Defined cases: null or empty text has all-zero statistics and is scored like any other; repeated rows
are scored each; no usable label gives every row the score 0.5; an empty table gives no rows; extra
columns are ignored; null labels and labels other than 0 and 1 are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpress.llm.bytewords import NONSPACE, Words, grams
from fieldpress.llm.shared import bounded_batches, col, materialise, slices, texts_of

SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE = 40_000, 80, 4, 64, 0.15, 1.0
#: Byte classes whose share of the text's bytes is a statistic.
CLASSES = (b"0123456789", bytes(range(65, 91)), b"#*$%&|<>", b".", b",", b"\n", b"@/:_\\", b"\"'()[]{}", b"!?;-+=~^`", bytes(range(128, 256)))
NAMES = ["bytes", "words", "word_mean", "word_sd", "long_words", "short_words", "distinct", "top_word", "repeats", "lines", "line_words", "dup_lines", "line_ends", *(f"class_{i}" for i in range(len(CLASSES)))]


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)) float32."""
    w = Words(texts, NONSPACE, lower=False)
    out = np.zeros((len(texts), len(NAMES)), np.float32)
    size = np.diff(w.text_starts) - 1
    table = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES):
        table[list(members)] = i
    kinds = table[w.buf]
    first = len(NAMES) - len(CLASSES)
    for i in range(len(CLASSES)):
        upto = np.concatenate(([0], np.cumsum(kinds == i, dtype=np.int64)))
        out[:, first + i] = (upto[w.text_starts[1:] - 1] - upto[w.text_starts[:-1]]) / np.maximum(1, size)
    lens = (w.ends - w.starts).astype(np.float64)
    runs = grams(w.hash, 3)
    newline = np.flatnonzero(w.buf == 10)
    nl = np.searchsorted(newline, w.text_starts)
    for i, (a, b) in enumerate(zip(w.bounds.tolist(), w.bounds[1:].tolist(), strict=False)):
        n = b - a
        if not n:
            continue
        h, own = np.sort(w.hash[a:b]), lens[a:b]
        edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        r = np.sort(runs[a : b - 2]) if n > 2 else h[:0]
        starts = np.concatenate(([w.text_starts[i]], newline[nl[i] : nl[i + 1]] + 1))
        cuts = np.searchsorted(w.starts[a:b], starts)
        per_line = np.diff(np.append(cuts, n))
        full = np.flatnonzero(per_line)
        sums = np.add.reduceat(w.hash[a:b] * (np.arange(n, dtype=np.uint64) - np.repeat(cuts[full], per_line[full]).astype(np.uint64) * np.uint64(1) + np.uint64(7)), cuts[full])
        out[i, :first] = (
            np.log1p(size[i]), np.log1p(n), own.mean(), own.std(), (own > 20).mean(), (own < 3).mean(), (len(edges) - 1) / n, np.diff(edges).max() / n,
            (r[1:] == r[:-1]).mean() if len(r) > 1 else 0, np.log1p(len(full)), n / len(full), 1 - len(np.unique(sums)) / len(full), (np.isin(w.buf[w.ends[a + np.append(cuts[full][1:], n) - 1] - 1], (46, 33, 63))).mean(),
        )
    return out


class Forest:
    """Complete trees as arrays: node k of a level has children 2k + 1 and 2k + 2; leaves follow the last level."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(x), self.base)
        trees = np.arange(len(self.leaf))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic loss, second-order gains, level by level; empty nodes keep a cut that sends all rows left."""
    n, m = x.shape
    inner = 2**DEPTH - 1
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(p / (1 - p))) if n else 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)  # bin b: x <= cuts[b]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width = 2**level
            best = np.full(width, 1e-6)
            pick = [(0, np.inf, BINS)] * width
            for j in range(m):
                k = len(cuts[j])
                if not k:
                    continue
                code = node * BINS + binned[:, j]
                gl, hl = (np.bincount(code, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = (gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE))[:, :k]
                gain[(hl[:, :k] < 1) | ((ht - hl)[:, :k] < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for i in np.flatnonzero(top > best).tolist():
                    best[i], pick[i] = top[i], (j, float(cuts[j][at[i]]), int(at[i]))
            which = np.array([q[0] for q in pick])
            limit = np.array([q[2] for q in pick])
            for i, (j, c, _) in enumerate(pick):
                feature[t, width - 1 + i], cut[t, width - 1 + i] = j, c
            node = 2 * node + (binned[np.arange(n), which[node]] > limit[node])
        leaf[t] = -RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + RIDGE)
        margin += leaf[t][node]
    return Forest(feature, cut, leaf, base)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = statistics(col(part, "text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([col(part, "doc_id").cast(pa.int64()), flat], ["doc_id", "x"])

    return texts_of(docs, "doc_id").mapInArrow(run, "doc_id long, x array<float>")


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def train(described: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: tuple[int, int] = (4, 2)) -> Forest:
    """Fit on at most `sample` labelled rows outside the held-out fold, the same ones for any partitioning."""
    own = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("y")).where("y IN (0, 1)").where(remainder(held[0]) != held[1])
    level = F.call_function("shiftright", F.xxhash64("doc_id"), F.lit(48)).alias("level")
    counts = {r.level: r.n for r in own.groupBy(level).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 65,536 rows
    least = sorted(counts)
    upto = next((k for k, total in zip(least, np.cumsum([counts[k] for k in least]).tolist(), strict=True) if total >= 2 * sample), 1 << 16)
    some = own.where(level <= upto)  # so few rows are ordered, whatever the table; labels without a document may leave fewer
    rows = some.join(described, "doc_id").select("doc_id", "y", "x").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample)
    found = rows.toArrow().to_batches()
    x = np.concatenate([np.zeros((0, len(NAMES)), np.float32), *(b.column(2).flatten().to_numpy().reshape(-1, len(NAMES)) for b in found)])
    y = np.concatenate([np.zeros(0), *(b.column(1).to_numpy() for b in found)]).astype(np.float64)
    return fit(x, y)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = 0.7) -> DataFrame:
    """Every document's held_out, score and predicted."""
    table = materialise(described(docs), "described")
    forest = docs.sparkSession.sparkContext.broadcast(train(table, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.value.score(col(b, "x").flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.record_batch([col(b, "doc_id"), col(b, "held_out"), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = table.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "x")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
