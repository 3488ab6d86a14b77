"""Repeated passages across documents: paragraph MinHash bands, exact verification, clusters, removal.

Two kinds of paragraphs are compared. Lines of at least `LEAST` words, and blocks of several lines between
blank lines, which may be wrapped differently or changed in every line, find near copies: their signature is
the minima of `BANDS * ROWS` hash functions over five-word shingles, 16 bands of 3 rows bring together
99.999 % of the pairs at similarity 0.8, colliding paragraphs are joined key by key, verified by exact
Jaccard similarity, and clustered by connected components. Passages that were pasted into other text
share no line, so texts are also cut into passages at the minima of their two-word hashes in windows of
`PANE` words: wherever a run of words repeats, so do the cuts in it. A passage is three neighbouring
pieces, and a cluster is its equals, told by 64-bit hashes of all its words; a run long enough to be removed
has several passages that lie over one another, so one false equal removes nothing. A repeated run of 51
words is found but for 2 * PANE words at most.

Of a cluster with members in two documents or more, the one of the smallest (doc_id, first word) stays. The
others are found too, whatever their length, but are removed only where repeated paragraphs with at most
`GAP` words between them make a run of at least `RUN` words: a single common short line stays in the text.

Texts are read once for all keys and places: band keys and passages are matched as packed entries (see
`matching`), and a passage becomes a row only if its key was found twice. The sets of colliding paragraphs
are made in a second reading, from one document each.

Defined cases: null or empty text has no paragraphs; rows that repeat a doc_id count as one document, and
`deduplicated` leaves them as they are if their texts differ; a row without a doc_id is left as it is; an empty
table gives no rows; other columns, whatever their names, are kept by `deduplicated`, which replaces the text and
drops documents left without a word; words are `[^\\x20\\x09-\\x0D]+`, lower-cased A-Z.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpress.llm.bytewords import Words, grams, mix, randoms
from fieldpress.llm.jaccard_join import links, sets_batch, sets_of
from fieldpress.llm.matching import HELD_KEYS, Entries, dealt, parts_in_order, parts_of
from fieldpress.llm.shared import bounded_batches, checkpointed, col, discard, fresh, hinted, materialise, slices, texts_of

SHINGLE, LEAST, BANDS, ROWS = 5, 5, 16, 3
PANE, RUN, GAP = 10, 28, 4
#: 64-bit words of a paragraph's parity sketch.
SKETCH_WORDS = 16
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


class Lines:
    """The lines of a slice of texts that are long enough, and blocks of several lines: text number, first word, words, node, and shingle spans."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        line = np.searchsorted(np.flatnonzero(w.buf == 10), w.starts)
        jump = np.diff(line)
        (first, size), (block, long) = self._split(jump > 0), self._split(jump > 1)
        ends = np.searchsorted(first, block + long)
        several = ends - np.searchsorted(first, block) > 1
        first, size = np.concatenate((first, block[several])), np.concatenate((size, long[several]))
        first = first[size >= LEAST]
        self.first, self.size = first, size[size >= LEAST]
        self.text = np.searchsorted(w.bounds, first, "right") - 1
        self.runs = grams(w.hash, SHINGLE)
        self.lens = self.size - SHINGLE + 1
        at, ends = self._spans(np.arange(len(first)))
        if len(first):
            rank = np.arange(len(at)) - np.repeat(ends - self.lens, self.lens)
            k = randoms(int(self.lens.max()), 31)
            self.node = mix(np.add.reduceat(mix(self.runs[at]) * k[rank], ends - self.lens) + self.lens.astype(np.uint64)).view(np.int64)
        else:
            self.node = np.zeros(0, np.int64)

    def _split(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and words of what lies between these breaks, and between texts."""
        n = len(self.words.starts)
        new = np.zeros(n + 1, bool)
        new[1:n] = breaks
        new[self.words.bounds] = True
        new[[0, n]] = True
        cuts = np.flatnonzero(new)
        return cuts[:-1], np.diff(cuts)

    def _spans(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles of some paragraphs in a row, and where each one's end."""
        lens = self.lens[which]
        ends = np.cumsum(lens)
        return np.repeat(self.first[which] - ends + lens, lens) + np.arange(int(lens.sum())), ends

    def keys(self, which: np.ndarray) -> np.ndarray:
        """(len(which), BANDS) band keys."""
        at, ends = self._spans(which)
        g, cuts = self.runs[at], ends - self.lens[which]
        out = np.zeros((len(which), BANDS), np.uint64)
        a, c = randoms(BANDS * ROWS, 41), randoms(BANDS * ROWS, 43)
        for i in range(BANDS * ROWS):
            out[:, i // ROWS] += np.minimum.reduceat(g * a[i], cuts) * c[i]
        return mix(out + randoms(BANDS, 47))

    def tokens(self, i: int) -> np.ndarray:
        return np.unique(self.runs[self.first[i] : self.first[i] + self.lens[i]])


def passages(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, words, node) of the passages of a slice of texts."""
    g = grams(w.hash, 2)
    empty = np.zeros(0, np.int64)
    if len(g) < PANE:
        return empty, empty, empty, empty
    panes = np.lib.stride_tricks.sliding_window_view(g, PANE)
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    inside = text[: len(panes)] == text[PANE : PANE + len(panes)]
    cuts = np.unique((np.arange(len(panes)) + panes.argmin(axis=1))[inside])
    if len(cuts) < 4:
        return empty, empty, empty, empty
    size = np.diff(cuts)
    rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    k = randoms(int(rank.max()) + 1, 53)
    piece = np.add.reduceat(mix(w.hash[cuts[0] : cuts[-1]]) * k[rank], cuts[:-1] - cuts[0]) + size.astype(np.uint64)
    a, b, c = randoms(3, 59)
    node = mix(mix(piece[:-2]) * a + mix(piece[1:-1]) * b + mix(piece[2:]) * c)
    good = text[cuts[:-3]] == text[cuts[3:]]
    return text[cuts[:-3]][good], cuts[:-3][good], (cuts[3:] - cuts[:-3])[good], node[good].view(np.int64)


#: Kinds of rows that are dealt: members of a band key, ready and others; places of passages, ready and others; places of lines.
KEYS_READY, KEYS, PASSAGES_READY, PASSAGES, LINES = range(5)
#: Kinds of rows of `_collisions`.
MEMBER, LINE, PASSAGE = range(3)
FOUND_DDL = "kind int, key long, node long, doc_id long, first int, words int"
PLACE = ["i8", "i8", "i4", "i4"]


def _collisions(docs: DataFrame) -> DataFrame:
    """Members (key, node) of band keys that several paragraphs have; and places (node, doc_id, first, words) of all lines and of passages found twice."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks, parts = parts_of(spark, 2 * size)
    names = [f.split()[0] for f in FOUND_DDL.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, same, lines = Entries(parts, ["u8", "i8"], KEYS_READY, KEYS), Entries(parts, PLACE, PASSAGES_READY, PASSAGES), Entries(parts, PLACE, LINES, LINES)
        seen = np.zeros(0, np.int64)
        for part in slices(batches):
            p = Lines(col(part, "text"))
            doc = col(part, "doc_id").to_numpy(zero_copy_only=False)
            text, first, size, node = passages(p.words)
            same.add(node, doc[text], first - p.words.bounds[text], size)
            lines.add(p.node, doc[p.text], p.first - p.words.bounds[p.text], p.size)
            nodes, one = np.unique(p.node, return_index=True)
            new = ~np.isin(nodes, seen, assume_unique=True)
            seen = np.concatenate((seen, nodes[new])) if len(seen) < 1_000_000 else nodes
            if new.any():
                near.add(p.keys(one[new]).ravel(), np.repeat(nodes[new], BANDS))
            for held in (near, same):
                if held.size >= HELD_KEYS:
                    yield from held.out()
            if lines.size >= 1 << 14:
                yield from lines.all()
        yield from near.out()
        yield from same.out()
        yield from lines.all()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, places = Entries(parts, ["u8", "i8"], KEYS_READY, KEYS), Entries(parts, PLACE, PASSAGES_READY, PASSAGES)
        for kind, blobs in parts_in_order(batches, {KEYS, PASSAGES}):
            own = pairs if kind <= KEYS else places
            columns = own.joined(blobs) if kind in (KEYS, PASSAGES) else own.unpacked(blobs[0])
            mark = MEMBER if kind <= KEYS else LINE if kind == LINES else PASSAGE
            for a in range(0, len(columns[0]), 100_000):
                c = [x[a : a + 100_000] for x in columns]
                none = lambda t, n=len(c[0]): pa.nulls(n, t)
                rest = [pa.array(c[0].view(np.int64)), pa.array(c[1]), none(pa.int64()), none(pa.int32()), none(pa.int32())] if mark == MEMBER else [none(pa.int64()), *map(pa.array, c)]
                yield pa.record_batch([pa.array(np.full(len(c[0]), mark, np.int32)), *rest], names)

    return materialise(dealt(docs, emit, tasks, match, FOUND_DDL), "collisions")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, sketch, tokens) of the wanted lines (node, doc_id)."""

    def make(part: pa.RecordBatch, pick) -> pa.RecordBatch:
        p = Lines(col(part, "text"))
        good = np.flatnonzero(pick(p.node, col(part, "doc_id").to_numpy(zero_copy_only=False)[p.text]))
        good = good[np.unique(p.node[good], return_index=True)[1]].tolist()
        return sets_batch(p.node[good].tolist(), [p.tokens(i) for i in good], SKETCH_WORDS)

    return sets_of(docs, wanted, make)


def repeats(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, list[DataFrame]]:
    """Every occurrence of a repeated line, block or passage: doc_id, first, upto (words), run, source_doc_id (the cluster's smallest), removed (not the cluster's first, in a run of `RUN` words); and the tables behind it."""
    bounded_batches(docs.sparkSession)
    texts = texts_of(docs, "doc_id").where("doc_id IS NOT NULL")
    rows = _collisions(texts)
    members = rows.where(F.col("kind") == MEMBER).select("key", "node")
    nodes = hinted(checkpointed(members.select("node").distinct()))
    wanted = checkpointed(rows.where(F.col("kind") == LINE).join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    sets = _sets(texts, wanted)
    of = links(members, sets, percent)
    discard(sets)
    each = rows.where(F.col("kind") != MEMBER).select("node", "doc_id", F.col("first").cast("long").alias("first"), F.col("words").cast("long").alias("words"))
    kinds = each.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct("doc_id", "first")).alias("keeper"))
    kinds = materialise(kinds.join(hinted(of), "node", "left").where("component IS NOT NULL OR low <> high"), "kinds")
    alone = kinds.where("component IS NULL").select("node", F.col("low").alias("source_doc_id"), "keeper")
    several = kinds.where("component IS NOT NULL")
    merged = several.groupBy("component").agg(F.min("low").alias("source_doc_id"), F.max("high").alias("most"), F.min("keeper").alias("keeper")).where("source_doc_id <> most")
    named = alone.union(several.select("node", "component").join(hinted(checkpointed(merged)), "component").select("node", "source_doc_id", "keeper"))
    found = each.join(named, "node")  # a passage that very many documents have: adaptive execution splits its rows
    stays = (F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("first") == F.col("keeper.first"))
    found = found.select("doc_id", "first", (F.col("first") + F.col("words")).alias("upto"), "source_doc_id", (~stays).alias("removed"))
    ordered = Window.partitionBy("doc_id").orderBy("first", "upto")
    reached = F.max("upto").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("first") > reached + GAP).cast("int"), F.lit(1)))
    found = found.withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "run")
    found = found.withColumn("size", F.max("upto").over(whole) - F.min("first").over(whole))
    return found.withColumn("removed", F.col("removed") & (F.col("size") >= RUN)).drop("new", "size"), [rows, kinds]


def repeated(docs: DataFrame, percent: int = 80, least: int = 0) -> DataFrame:
    """One row per run of at least `least` repeated words: doc_id, first_word, n_words, removed_words, source_doc_ids (the smallest documents of its clusters)."""
    found, _ = repeats(docs, percent)
    spans = F.sort_array(F.collect_set(F.when(F.col("removed"), F.struct("first", "upto"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("at"))
    covered = F.aggregate(spans, start, lambda s, x: F.struct((s["total"] + F.greatest(F.lit(0).cast("long"), x["upto"] - F.greatest(x["first"], s["at"]))).alias("total"), F.greatest(s["at"], x["upto"]).alias("at")))
    made = found.groupBy("doc_id", "run").agg(F.min("first").alias("first_word"), F.max("upto").alias("upto"), covered["total"].alias("removed_words"), F.sort_array(F.collect_set("source_doc_id")).alias("source_doc_ids"))
    return made.select("doc_id", "first_word", (F.col("upto") - F.col("first_word")).alias("n_words"), "removed_words", "source_doc_ids").where(F.col("n_words") >= least)


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words of these spans; up to `GAP` words between two spans go with them, and so does the white space after them."""
    runs: list[list[int]] = []
    for a, b in sorted(gone):
        if runs and a <= runs[-1][1] + GAP:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : words[a][0]])
        at = words[b][0] if b < len(words) else len(text)
    return "".join([*out, text[at:]])


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without their removed words; those left without a word are dropped."""
    names = docs.columns
    doc, spans = fresh(names, "removed_doc"), fresh([*names, "removed_doc"], "removed_spans")
    found, behind = repeats(docs, percent)
    gone = found.where("removed").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.array("first", "upto"))).alias("spans"))
    digest = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    differ = docs.select(docs["doc_id"].alias("doc_id"), digest.alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id")
    gone = materialise(gone.join(hinted(checkpointed(differ)), "doc_id", "left_anti"), "gone")
    discard(*behind)
    gone = gone.select(F.col("doc_id").alias(doc), F.col("spans").alias(spans))
    both = docs.join(gone, docs["doc_id"] == gone[doc], "left").select(*[docs[c] for c in names], spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            gone = col(part, spans).to_pylist()
            texts = [t if g is None or t is None else without(t, g) for t, g in zip(col(part, "text").to_pylist(), gone, strict=True)]
            keep = pa.array([g is None or bool(_WORD.search(t or "")) for t, g in zip(texts, gone, strict=True)], pa.bool_())
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else col(part, c) for c in names], names).filter(keep)

    return both.mapInArrow(run, docs.schema)
