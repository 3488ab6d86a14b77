"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(slot | class, context) * P(token | slot). Every token has a class and
a slot whose chances depend on the context, whatever the vocabulary's size. The `CORE * SLOTS` most frequent
tokens have a slot of their own, dealt by rank. Any other token, also one never seen, shares a slot of one of
`REST` classes with the tokens of its shape (last two bytes and length), within which it has its smoothed
relative frequency. Both softmaxes start from the smoothed frequencies, and add hashed weights of three
features of the context: the token before, the one before that (skip), and the two as a pair. The tables of weights have four rows per distinct training token, up to `ROWS_MOST`.

Counts of all training tokens are summed in a shuffle and stay a table; only the `HEAD` most frequent are
broadcast, and rarer tokens of documents are joined to the table. Weights are trained by distributed
gradient updates: in each round every task runs mini-batch updates over its training documents from the
common weights, and the changes are averaged per weight row, by how often each task touched it, in two
steps, so that no task gathers the changes of all others. Every training document is learnt from in exactly
one round. Scoring is one pass in numpy batches.

Tokens are words `[^\\x20\\x09-\\x0D]+`, lower-cased A-Z, told apart by 64-bit hashes, and one end per text.
Defined cases: null or empty text is its end token alone; a null doc_id is held out; repeated rows are each
learnt from and scored; without training documents every score is 0; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpress.llm.bytewords import Words, mix
from fieldpress.llm.shared import bounded_batches, col, longs, materialise, slices, texts_of

CORE, REST, SLOTS, BATCH, STEP = 8, 24, 32, 8192, 0.4
CLASSES = CORE + REST
#: Rows of a table of weights, at least and at most; row numbers are 16 bits.
ROWS_LEAST, ROWS_MOST = 1 << 12, 1 << 16
HEAD = 1 << 17
#: Distinct tokens that a task counts before it sends them on.
HELD = 2_000_000
#: Training documents of round r: those whose hash has its remainder modulo `ROUNDS[-1]` in this range.
ROUNDS = ((0, 2), (2, 16))
END, START = np.uint64(0x7F4A7C15F39CC060), np.uint64(0x1CE4E5B9BF58476D)
FEATURES = 3
BLOCK = 1 << 10
#: Tasks whose changes are averaged together first.
NEAR = 32


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a slice of texts, each text's end included, their shapes, and each text's bounds."""
    w = Words(texts)
    last, before = w.buf[w.ends - 1].astype(np.uint32), w.buf[np.maximum(w.ends - 2, w.starts)].astype(np.uint32)
    length = np.minimum(w.ends - w.starts, 15).astype(np.uint32) // 3
    shape = (last * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(REST) * np.uint32(SLOTS) + ((before * np.uint32(7) + length) * np.uint32(0x85EBCA6B) >> np.uint32(16)) % np.uint32(SLOTS)
    return np.insert(w.hash, w.bounds[1:], END), np.insert(shape.astype(np.int16), w.bounds[1:], 0), w.bounds + np.arange(len(w.bounds))


def count(docs: DataFrame) -> DataFrame:
    """(h, shape, c): how often each token is in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shapes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not held:
                return keys, shapes, counts
            h, s = (np.concatenate(x) for x in zip(*held, strict=True))
            k, one, c = np.unique(h, return_index=True, return_counts=True)
            k, s, c = np.concatenate((keys, k)), np.concatenate((shapes, s[one])), np.concatenate((counts, c))
            order = np.argsort(k, kind="stable")
            k, s, c = k[order], s[order], c[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
            return k[first], s[first], np.add.reduceat(c, first) if len(first) else c

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(shapes), pa.array(counts)], ["h", "shape", "c"])

        for part in slices(batches):
            held.append(tokens(col(part, "text"))[:2])
            size += len(held[-1][0])
            if size > 1 << 20:
                keys, shapes, counts = merged()
                held, size = [], 0
                if len(keys) > HELD:
                    yield out()
                    keys, shapes, counts = keys[:0], shapes[:0], counts[:0]
        keys, shapes, counts = merged()
        if len(keys):
            yield out()

    each = docs.where("NOT held_out").select("text").mapInArrow(run, "h long, shape short, c long")
    return materialise(each.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")), "token-counts")


class Model:
    """Frequencies and weights; what is broadcast to tasks, of bounded size."""

    def __init__(self, total: int, kinds: int, head: np.ndarray, head_counts: np.ndarray, core_shapes: np.ndarray, mass: np.ndarray, rows: int | None = None):
        """head: token hashes by falling count, and the shapes of the first; mass: counts of all training tokens plus a half each, by shape."""
        self.total, self.kinds = total, kinds
        self.floor = np.log(total + 0.5 * (kinds + 1))
        order = np.argsort(head)
        self.head, self.head_counts = head[order], head_counts[order]
        size = CORE * SLOTS
        core, n = head[:size], head_counts[:size] + 0.5
        self.place = np.argsort(core)
        self.core = core[self.place]
        own = np.zeros(CLASSES * SLOTS)
        own[: len(n)] = n
        own[size:] = np.maximum(mass - np.bincount(core_shapes[: len(n)], n, REST * SLOTS), 0) + 0.5  # a half for tokens never seen
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(own.reshape(CLASSES, SLOTS).sum(axis=1)), -60).astype(np.float32)
            self.slot_bias = np.maximum(np.log(own.reshape(CLASSES, SLOTS)), -60).astype(np.float32)
        self.log_mass = np.log(own[size:])
        self.rows = rows or min(ROWS_MOST, max(ROWS_LEAST, 1 << (4 * kinds).bit_length()))
        self.w = np.zeros((self.rows, CLASSES), np.float32)
        self.v = np.zeros((self.rows, SLOTS), np.float32)

    def targets(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Class * SLOTS + slot of each token."""
        rest = CORE * SLOTS + shape.astype(np.int64)
        if not len(self.core):
            return rest
        at = np.minimum(np.searchsorted(self.core, h), len(self.core) - 1)
        return np.where(self.core[at] == h, self.place[at], rest)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Training counts of head tokens, -1 of others."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_counts[at], -1)

    def rows_of(self, f: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
        """(FEATURES, tokens) rows of weights: of the class table, or of the slot table for these classes."""
        if cls is not None:
            f = (f ^ (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return (f >> np.uint64(65 - self.rows.bit_length())).astype(np.uint16)


def features(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens) hashes of each token's context within its text."""
    rank = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = [np.where(rank >= k, np.concatenate((np.full(k, START), h[:-k]))[: len(h)], START) for k in (1, 2)]
    pair = mix(before[0] * np.uint64(3) + before[1])
    return np.stack([mix(x + np.uint64(k * 0x9E3779B9)) for k, x in enumerate((*before, pair))])


def logits(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = table.take(rows[0], axis=0)
    for r in rows[1:]:
        x += table.take(r, axis=0)
    x += bias
    return x


def softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, in the place of x, and the logarithms of the norms."""
    top = x
    while top.shape[1] > 1:  # far quicker than a maximum over a short axis
        half = -(-top.shape[1] // 2)
        top = np.maximum(top[:, :half], top[:, -half:])
    x -= top
    np.exp(x, out=x)
    norm = x.sum(axis=1, keepdims=True)
    x /= norm
    return x, (np.log(norm) + top)[:, 0]


def run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run that begins at `first`: place by place for short runs, as products for the others."""
    n = np.diff(np.append(first, len(x)))
    out = x[first]
    for k in range(1, 8):
        at = np.flatnonzero((n > k) & (n <= 8))
        out[at] += x[first[at] + k]
    ones = np.ones(int(n.max(initial=1)), x.dtype)
    for i in np.flatnonzero(n > 8).tolist():
        out[i] = ones[: n[i]] @ x[first[i] : first[i] + n[i]]
    return out


class Trainer:
    """One task's updates from the common weights."""

    def __init__(self, model: Model):
        self.model = model
        self.w, self.v = model.w.copy(), model.v.copy()
        self.sums = [np.full(model.rows, 1e-3, np.float32) for _ in range(2)]
        self.touched = [np.zeros(model.rows, np.float32) for _ in range(2)]

    def _update(self, which: int, rows: np.ndarray, error: np.ndarray) -> None:
        weights = (self.w, self.v)[which]
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")  # a radix sort, of 16 bits
        ordered = flat[order]
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        own, g = ordered[cuts], run_sums(error.take(np.tile(np.arange(len(error)), FEATURES).take(order), axis=0), cuts)
        self.touched[which][own] += np.diff(np.append(cuts, len(flat)))
        sums = self.sums[which][own] + np.einsum("ij,ij->i", g, g)
        self.sums[which][own] = sums
        g *= (STEP / np.sqrt(sums))[:, None]
        weights[own] -= g

    def learn(self, h: np.ndarray, shape: np.ndarray, bounds: np.ndarray) -> None:
        m = self.model
        target, f = m.targets(h, shape), features(h, bounds)
        for a in range(0, len(h), BATCH):
            t, x = target[a : a + BATCH], f[:, a : a + BATCH]
            every, cls = np.arange(len(t)), t // SLOTS
            for which, rows, bias, hit in ((0, m.rows_of(x), m.bias, cls), (1, m.rows_of(x, cls), m.slot_bias[cls], t % SLOTS)):
                p, _ = softmax(logits(bias, (self.w, self.v)[which], rows))
                p[every, hit] -= 1
                self._update(which, rows, p)

    def changes(self) -> Iterator[pa.RecordBatch]:
        """Changes times touches, in blocks of rows; halves the size by half precision."""
        for which, (now, then) in enumerate(((self.w, self.model.w), (self.v, self.model.v))):
            for a in range(0, self.model.rows, BLOCK):
                n = self.touched[which][a : a + BLOCK]
                if n.any():
                    yield pa.record_batch([pa.array([which]), pa.array([a]), pa.array([(now - then)[a : a + BLOCK].astype(np.float16).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["which", "first", "change", "touched"])


CHANGE = "which long, first long, change binary, touched binary"


def averaged(table: pa.Table) -> pa.Table:
    """One block's mean change, weighted by touches, and their sum."""
    total = weight = 0
    for change, touched in zip(table.column("change"), table.column("touched"), strict=True):
        n = np.frombuffer(touched.as_py(), np.float32)
        total = total + np.frombuffer(change.as_py(), np.float16).reshape(len(n), -1).astype(np.float32) * n[:, None]
        weight = weight + n
    mean = (total / np.maximum(weight, 1)[:, None]).astype(np.float16)
    return pa.table({"which": table.column("which")[:1], "first": table.column("first")[:1], "change": pa.array([mean.tobytes()], pa.binary()), "touched": pa.array([weight.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, model: Model) -> Model:
    """Rounds of parallel updates over all training documents."""
    spark = docs.sparkSession
    rest = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(ROUNDS[-1][1]))
    for low, high in ROUNDS:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trainer = None
            for part in slices(batches):
                trainer = trainer or Trainer(shared.value)
                trainer.learn(*tokens(col(part, "text")))
            if trainer is not None:
                yield from trainer.changes()

        sent = docs.where("NOT held_out").where(rest.between(low, high - 1)).select("text").mapInArrow(run, CHANGE).withColumn("near", (F.spark_partition_id() / NEAR).cast("int"))
        near = sent.groupBy("which", "first", "near").applyInArrow(averaged, CHANGE)
        for r in near.groupBy("which", "first").applyInArrow(averaged, CHANGE).collect():  # as large as the weights
            own = (model.w, model.v)[r.which]
            own[r.first : r.first + BLOCK] += np.frombuffer(r.change, np.float16).astype(np.float32).reshape(-1, own.shape[1])
        shared.unpersist()
    return model


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>"


def log_chances(m: Model, target: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Log chance of each token's slot in its context."""
    out = np.zeros(len(target))
    for a in range(0, len(target), BATCH):
        t, x = target[a : a + BATCH], f[:, a : a + BATCH]
        every, cls = np.arange(len(t)), t // SLOTS
        for table, rows, bias, hit in ((m.w, m.rows_of(x), m.bias, cls), (m.v, m.rows_of(x, cls), m.slot_bias[cls], t % SLOTS)):
            z = logits(bias, table, rows)
            own = z[every, hit]
            out[a : a + BATCH] += own - softmax(z)[1]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: what contexts, head and core tokens add to its scores, and the hashes of its other tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            h, shape, bounds = tokens(col(part, "text"))
            target, c = m.targets(h, shape), m.counts(h)
            logp = log_chances(m, target, features(h, bounds))
            head = c > 0
            unigram = np.where(head, np.log(np.maximum(c, 0) + 0.5), 0.0)
            base = unigram - m.floor
            rest = target >= CORE * SLOTS
            logp[rest] += unigram[rest] - m.log_mass[target[rest] - CORE * SLOTS]
            at = bounds[:-1]
            tail = h[~head].view(np.int64)
            cuts = np.concatenate(([0], np.cumsum(~head)))[bounds]
            n = part.num_rows
            yield pa.record_batch(
                [pa.array(row + np.arange(n)), col(part, "doc_id").cast(pa.int64()), col(part, "held_out"), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(head.astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logp, at)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tail))],
                ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"],
            )
            row += n

    return materialise(docs.mapInArrow(run, SCORED), "scored")


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, shape) of at most `most` tokens by falling count: all from the least count on of which they are not too many."""
    levels = counts.groupBy(F.floor(F.log2("c") * 64).alias("level")).agg(F.count(F.lit(1)).alias("kinds")).collect()  # a few thousand rows
    least, left = 1 << 30, most
    for r in sorted(levels, key=lambda r: -r.level):
        if (left := left - r.kinds) < 0:
            break
        least = r.level
    h, c, shape = longs(counts.where(F.floor(F.log2("c") * 64) >= least).select("h", "c", F.col("shape").cast("long")))
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order], shape[order]


def fitted(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training rows, and their token counts."""
    counts = count(rows)
    sums = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds")).collect()
    total, kinds = (sum(getattr(r, f) for r in sums) for f in ("c", "kinds"))
    mass = np.zeros(REST * SLOTS)
    for r in sums:
        mass[r["shape"]] = r.c + 0.5 * r.kinds
    h, c, shape = most_frequent(counts, HEAD)
    return train(rows, Model(total, kinds, h, c, shape, mass)), counts


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    bounded_batches(docs.sparkSession)
    rows = texts_of(docs, "doc_id").withColumn("held_out", held_out())
    model, counts = fitted(rows)
    scored = score(rows, model)
    tail = scored.select("rid", F.explode("tail").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("n"))
    found = tail.join(counts.select("h", "c"), "h").groupBy("rid").agg(F.sum("n").alias("found"), F.sum(F.col("n") * F.ln(F.col("c") + 0.5)).alias("logs"))
    both = scored.drop("tail").withColumn("tail_n", F.col("n_tokens") - F.col("known")).join(found, "rid", "left")
    found_n = F.coalesce("found", F.lit(0))
    more = F.coalesce("logs", F.lit(0.0)) + (F.col("tail_n") - found_n) * float(np.log(0.5))
    ten, total = float(np.log(10)), model.total
    score_of = (F.col("score") + more) / ten if total else F.lit(0.0)
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + found_n).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), ((F.col("base") + more) / ten).alias("base_score"), score_of.alias("score"))
