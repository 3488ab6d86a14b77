"""Jaccard self-join on word shingles by parity sketches, exact.

A document's shingles are hashed to 64 bits and flip bits of sketches, so that the sketches of two
sets differ by no more than their symmetric difference. At similarity 0.8 the symmetric difference of
sets of a and b shingles is at most (a + b) / 9. A sketch is made of segments, each the XOR of the
hashes that fall into its share of the hash space, per band of set sizes. By the pigeonhole principle
each document needs only its first D + 1 non-empty segments as join keys, D the largest difference
that any partner may have: a differing shingle spoils one segment at most, so one of them is equal.

* Shingles that very many documents have (lossy counts over all documents) are left out of the
  segments; this lowers the symmetric difference only, so no link is lost. Documents with too few
  segments left add keys made of all their shingles; two of them meet there, any other pair already
  has. Sets below `SMALL` shingles have segments so fine that each holds one shingle.
* The nodes of the join are distinct sets, named by a digest of which no two sets have the same: that is
  checked, and another seed taken if need be. Exact copies are one node from the start, and rows of one
  doc_id with different texts are different nodes.
* Keys are matched as packed arrays (see `matching`); keys with the same members count once. Of each key,
  the members are first paired with its smallest, never with each other.
* Candidates are tested by size and by the Hamming distance of a wide parity sketch, then verified on
  their full sets. Keys whose members are not all in one component then have their members of
  different components tested against each other, in units of bounded blocks: no link is lost.
* A key of very many members that stay apart is most often a passage that unlike documents share. Such
  members are joined once more among themselves, as a corpus of their own: its frequent shingles, left
  out of the segments, are those of the passage. Their links are found by that, not by testing all pairs.

Defined cases: null text, or text without words, has an empty set and links with nothing; repeated rows of a
doc_id get a row each; a row without a doc_id links with nothing and has a null component; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpress.llm.bytewords import Words, mix, shingle_sets
from fieldpress.llm.components import components
from fieldpress.llm.matching import HELD_KEYS, Entries, dealt, packed, parts_in_order, parts_of, row, unpacked
from fieldpress.llm.shared import BROADCAST_BYTES, bounded_batches, checkpointed, col, discard, hinted, longs, materialise, slices, texts_of

SHINGLE = 5
#: Texts per lossy count, the least count that is kept, and the most frequent shingles that are left out.
HOT_BYTES, HOT_LEAST, HOT_MOST = 8 << 20, 4, 1 << 16
#: Partners of a node that one unit of work has, about.
UNIT = 256
#: Members of a key that one unit tests against each other, or against as many others.
CROSS = 1024
#: Members of keys of more than this are joined among themselves, `DEPTH` times at most, before they are all tested: it takes some
#: fifty stages, which is more than the pairs of fewer members cost.
VERY, DEPTH = 16 * CROSS, 2
#: Turns of one pivot per key of more than `CROSS` members before its members of different components are all tested.
PIVOTS = 3
SKETCH_WORDS = 32
SMALL = 64


def bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(2 * edges[-1])
    return np.array(edges, np.int64)


EDGES = bands()


def band(n: int) -> int:
    return int(np.searchsorted(EDGES, n, "right")) - 1


def most_apart(n: int) -> int:
    """Largest symmetric difference of a set of n shingles and any partner at 0.8."""
    return (n + n * 5 // 4) // 9


def segments(tokens: np.ndarray, level: int, need: int, seed: int) -> np.ndarray:
    """Keys of the first `need` non-empty segments of a sorted token array at a level."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    if EDGES[level] < SMALL:
        return mix(tokens[:need] ^ salt)
    m = np.uint64(-(-int(EDGES[level + 1]) // 2))
    cell = ((tokens >> np.uint64(32)) * m) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))[: need + 1] if len(tokens) else np.zeros(0, np.int64)
    if len(first) > need:
        tokens, first = tokens[: first[need]], first[:need]
    return mix(np.bitwise_xor.reduceat(mix(tokens ^ salt), first) + cell[first]) if len(first) else first.astype(np.uint64)


def join_keys(tokens: np.ndarray, hot: np.ndarray, seed: int) -> tuple[np.ndarray, bool]:
    """All keys of a set, and whether they suffice (else another seed is due)."""
    n, need, out, enough = len(tokens), most_apart(len(tokens)) + 1, [], True
    at = np.minimum(np.searchsorted(hot, tokens), max(0, len(hot) - 1))
    rare = tokens[hot[at] != tokens] if len(hot) else tokens
    for level in {band(n), band(-(-n * 4 // 5))}:
        out.append(segments(rare, level, need, seed))
        if len(out[-1]) < need and len(rare) < n:
            out.append(segments(tokens, level, need, seed + 7919))
        enough &= len(out[-1]) >= need
    return np.concatenate(out), enough


def digest(tokens: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    salt = np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    a = int(mix(tokens + np.uint64(0x632BE59BD9B4E019) + salt).sum(dtype=np.uint64)) if len(tokens) else 0
    b = int(np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0xA0761D6478BD642F)))) if len(tokens) else 0
    return np.uint64(a).astype(np.int64).item(), np.uint64(b).astype(np.int64).item()


def sketch(tokens: np.ndarray, least: int = SKETCH_WORDS) -> np.ndarray:
    """A parity sketch: each token flips one bit of two per token, a power of two words and `least` at least."""
    words = max(least, 1 << (max(1, len(tokens)) // 32).bit_length())
    bit = (mix(tokens) >> np.uint64(32)) % np.uint64(64 * words)
    flips = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) as ones of fewer words, those that the same tokens would give."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def texts_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of texts and their shingle sets."""
    for part in slices(batches):
        yield part, shingle_sets(Words(col(part, "text")), SHINGLE)


def stored_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of stored tokens."""
    for part in slices(batches, "tokens"):
        yield part, [np.frombuffer(t.as_py(), np.uint64) for t in col(part, "tokens")]


def frequent(docs: DataFrame, sets_in=texts_sets, column: str = "text") -> tuple[np.ndarray, int]:
    """Sorted shingles that many documents have, by lossy counts over all of them, a help for speed alone; and the bytes of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = total = 0

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= HOT_LEAST
            held.clear()
            return pa.record_batch([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

        for part, sets in sets_in(batches):
            held += sets
            size += col(part, column).nbytes
            total += col(part, column).nbytes
            if size >= HOT_BYTES:
                yield out()
                size = 0
        if held:
            yield out()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["h", "n"])

    counts = checkpointed(docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    levels = counts.groupBy(F.col("h").isNull().alias("total"), F.floor(F.log2("n") * 8).alias("level")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()  # a few hundred rows
    least, left = 1 << 30, HOT_MOST
    for r in sorted((r for r in levels if not r.total), key=lambda r: -r.level):
        if (left := left - r.kinds) < 0:
            break
        least = r.level
    (hot,) = longs(counts.where(F.col("h").isNotNull() & (F.floor(F.log2("n") * 8) >= least)).select("h"))
    return np.sort(hot.view(np.uint64)), sum(r.n for r in levels if r.total)


#: Kinds of rows that are dealt: a document's own, members of a key that are ready, and others.
OWN, READY, KEYED = 0, 1, 2
LONG = np.dtype(np.int64)
MATCHED_DDL = "key long, node long, doc_id long, n long, y long, enough boolean"


def members_batch(key: np.ndarray, node: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of members, the other columns null."""
    for a in range(0, len(key), 100_000):
        k, x = (pa.array(c[a : a + 100_000].view(np.int64)) for c in (key, node))
        yield pa.record_batch([k, x, *(pa.nulls(len(k), pa.bool_() if c == "enough" else pa.int64()) for c in names[2:])], names)


def matched(docs: DataFrame, hot: np.ndarray, seed: int, text_bytes: int) -> DataFrame:
    """Rows of two kinds: a document (key null) with its set's digest as node, or a member (n null) of a key of several nodes."""
    spark = docs.sparkSession
    tasks, parts = parts_of(spark, text_bytes)
    shared = spark.sparkContext.broadcast(hot)
    names = [f.split()[0] for f in MATCHED_DDL.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        held = Entries(parts, ["u8", "i8"], READY, KEYED)
        for part, sets in texts_sets(batches):
            own = []
            for doc, s in zip(col(part, "doc_id").to_pylist(), sets, strict=True):
                x, y = digest(s, seed)
                mark, enough = (len(s), x, y), True
                if len(s) and doc is not None and mark not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(mark)
                    keys, enough = join_keys(s, shared.value, seed)
                    held.add(keys, np.full(len(keys), x, np.int64))
                own.append((doc or 0, doc is not None, len(s), x, y, enough))
            yield row(abs(own[0][3]) % parts, OWN, packed(list(np.array(own, np.int64).T)))
            if held.size >= HELD_KEYS:
                yield from held.out()
        yield from held.out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(parts, ["u8", "i8"], READY, KEYED)
        for kind, blobs in parts_in_order(batches, {KEYED}):
            if kind == OWN:
                doc, known, n, x, y, enough = unpacked(blobs[0], [LONG] * 6)
                ids = pa.array(doc, mask=known == 0)
                yield pa.record_batch([pa.nulls(len(doc), pa.int64()), pa.array(x), ids, pa.array(n), pa.array(y), pa.array(enough > 0)], names)
            else:
                yield from members_batch(*(entries.joined(blobs) if kind == KEYED else entries.unpacked(blobs[0])), names)

    return materialise(dealt(docs, emit, tasks, match, MATCHED_DDL), "matched")


def rejoined(sets: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Members (key, node) of the keys that these nodes share when they are joined as a corpus of their own."""
    spark = sets.sparkSession
    own = materialise(sets.select("node", "tokens").join(hinted(nodes), "node"), "own-sets")
    hot, size = frequent(own, stored_sets, "tokens")
    tasks, parts = parts_of(spark, size)
    shared = spark.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        held = Entries(parts, ["u8", "i8"], READY, KEYED)
        for part, each in stored_sets(batches):
            for node, s in zip(col(part, "node").to_pylist(), each, strict=True):
                keys, enough = join_keys(s, shared.value, seed)
                held.add(keys, np.full(len(keys), node, np.int64))
                if not enough:
                    yield row(0, OWN, b"")
            if held.size >= HELD_KEYS:
                yield from held.out()
        yield from held.out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(parts, ["u8", "i8"], READY, KEYED)
        for kind, blobs in parts_in_order(batches, {KEYED}):
            if kind == OWN:
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["key", "node"])
            else:
                yield from members_batch(*(entries.joined(blobs) if kind == KEYED else entries.unpacked(blobs[0])), ["key", "node"])

    for seed in itertools.count(1000 * level):
        found = materialise(dealt(own, lambda batches, seed=seed: emit(batches, seed), tasks, match, "key long, node long"), "rejoined")
        if not found.where("key IS NULL").take(1):
            discard(own)
            return found
        discard(found)  # a set of too few segments
    raise AssertionError


SETS_DDL = "node long, n long, sketch array<long>, tokens binary"


def sets_batch(nodes: list[int], sets: list[np.ndarray], words: int = SKETCH_WORDS) -> pa.RecordBatch:
    return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, words) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "sketch", "tokens"])


def sets_of(docs: DataFrame, wanted: DataFrame, make) -> DataFrame:
    """(node, n, sketch, tokens) of the wanted (node, doc_id), each made from its document alone by `make(part, pick)`.

    The wanted pairs go to all tasks if they are within the bound, else to their documents by a join.
    `pick(node, doc)` tells which of a task's (node, document) are wanted.
    """
    spark = docs.sparkSession
    if wanted.count() * 16 <= BROADCAST_BYTES:
        nodes, owner = longs(wanted.select("node", "doc_id"))
        order = np.argsort(nodes)
        shared, chosen = spark.sparkContext.broadcast((nodes[order], owner[order], np.unique(owner))), docs
    else:
        shared, chosen = None, docs.join(wanted.groupBy("doc_id").agg(F.collect_list("node").alias("nodes")), "doc_id")

    def picker(nodes: np.ndarray, owner: np.ndarray):
        def pick(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
            if not len(nodes):
                return np.zeros(len(node), bool)
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            return (nodes[at] == node) & (owner[at] == doc)

        return pick

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                own = col(batch, "doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(np.isin(own, shared.value[2])))
            for part in slices(iter([batch])):
                if shared is not None:
                    nodes, owner = shared.value[:2]
                else:
                    lists = col(part, "nodes")
                    nodes, owner = lists.flatten().to_numpy(), np.repeat(col(part, "doc_id").to_numpy(), np.diff(lists.offsets.to_numpy()))
                    order = np.lexsort((owner, nodes))
                    nodes, owner = nodes[order], owner[order]
                yield make(part, picker(nodes, owner))

    sets = materialise(chosen.mapInArrow(run, SETS_DDL), "sets")
    distinct = sets.agg(F.count("node"), F.count_distinct("node")).first()
    if distinct[0] == distinct[1]:
        return sets
    once = materialise(sets.dropDuplicates(["node"]), "sets")  # rows that repeat a document
    discard(sets)
    return once


def likely(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches let pass."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"k{s}"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = side("b").join(side("a").join(hinted(checkpointed(pairs)), "a"), "b").where(sizes).select("a", "b", "na", "nb", "ka", "kb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            apart = np.zeros(len(a), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (z.values.to_numpy().view(np.uint64)[None] for z in (x, y))
                words = min(x.shape[1], y.shape[1])
                apart[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
            good = (100 + percent) * apart <= (100 - percent) * (n + m)
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return checkpointed(both.mapInArrow(test, "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The likely pairs (a, b) whose sets have 100 * intersection >= percent * union.

    A pair goes to a unit of its first node and a salt of the second, so that a node with many partners is
    dealt to many tasks, with its set sent once to each.
    """
    units = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("long").alias("units"))
    salted = pairs.join(units, "a").select("a", "b", F.pmod(F.xxhash64("b"), "units").alias("salt"))
    members = checkpointed(salted.select("a", "salt", F.col("b").alias("node")).union(salted.select("a", "salt", F.col("a").alias("node")).distinct()))
    loaded = sets.select("node", "tokens").join(hinted(members), "node")

    def check(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        sets = {node: np.frombuffer(t, np.uint64) for node, t in zip(table.column("node").to_pylist(), table.column("tokens").to_pylist(), strict=True)}
        own, good = sets.pop(a), []
        for node, other in sets.items():
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            common = int((own[at] == other).sum())
            if 100 * common >= percent * (len(own) + len(other) - common):
                good.append(node)
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return checkpointed(loaded.groupBy("a", "salt").applyInArrow(check, "a long, b long"))


def crossed(members: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of one key's members in different components that size and sketch let pass.

    `members`: (key, node, of). A key of more than `CROSS` members is dealt to units of two blocks each,
    so a unit's rows are bounded; pairs are tested within the unit and only those that pass leave it. With
    `forest`, a unit's pairs are no more than its members: of those that pass, only such as join what others
    have not joined yet; a row (key, null) tells that there are more.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROSS).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "of", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    units = dealt.join(sets.select("node", "n", "sketch"), "node").select("key", "i", "j", "node", "of", "block", "n", "sketch")

    def test(table: pa.Table) -> pa.Table:
        node, of, block, n = (table.column(c).to_numpy() for c in ("node", "of", "block", "n"))
        lists = table.column("sketch").combine_chunks()
        flat, begins = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = np.diff(begins)
        widths = np.unique(words).tolist()
        bits = {w: np.zeros((len(node), w), np.uint64) for w in widths}  # all sketches that are as wide, or folded to it
        for w in widths:
            own = np.flatnonzero(words == w)
            rows = flat[begins[own][:, None] + np.arange(w)]
            for narrow in (x for x in widths if x <= w):
                bits[narrow][own] = folded(rows, narrow) if narrow < w else rows
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        label, left_out = np.unique(of, return_inverse=True)[1], 0
        out: list[np.ndarray] = []
        for x in left.tolist():
            y = right[(of[right] != of[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if i == j:
                y = y[node[y] > node[x]]
            if not len(y):
                continue
            own = bits[min(int(words[x]), int(words[y].min()))]
            distance = np.bitwise_count(own[y] ^ own[x]).sum(axis=1, dtype=np.int64)
            y = y[(100 + percent) * distance <= (100 - percent) * (n[y] + n[x])]
            if forest and len(y):
                passed = len(y)
                y = y[label[y] != label[x]]
                labels, one = np.unique(label[y], return_index=True)
                y = y[one]
                label[np.isin(label, labels)] = label[x]
                left_out += passed - len(y)
            out.append(np.stack((np.minimum(node[y], node[x]), np.maximum(node[y], node[x])), axis=1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
        a, b = pairs[:, 0].tolist(), pairs[:, 1].tolist()
        return pa.table({"a": pa.array([*a, *[key] * (left_out > 0)], pa.int64()), "b": pa.array([*b, *[None] * (left_out > 0)], pa.int64())})

    return units.groupBy("key", "i", "j").applyInArrow(test, "a long, b long").distinct()


def links(members: DataFrame, sets: DataFrame, percent: int = 80, depth: int = 0) -> DataFrame:
    """(node, component) of all links between members (key, node) of a common key.

    Of keys with the same members one is enough. Each node is first verified against the smallest node that is the
    smallest of one of its keys and likely to be like it. While members of a key of more than `CROSS` are in several components, a pivot of
    it, another one in each of `PIVOTS` turns, is tested against its members of other components, so very large
    groups that are alike merge by pairs as many as they have members; what stays apart in keys of more than `VERY`
    is joined again as a corpus of its own. What then is apart in other keys is tested in full: a forest of the pairs
    that pass is verified first, and what is left of them once that has merged components.
    """
    h = F.xxhash64("node")
    alike = ["size", "total", "parity", "low"]
    every = materialise(members.distinct(), "members")
    marked = every.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(h % (1 << 40)).alias("total"), F.bit_xor(h).alias("parity"), F.min("node").alias("low")).where("size > 1")
    members = materialise(every.join(marked.groupBy(*alike).agg(F.min("key").alias("key")).select("key", "size", "low"), "key"), "members")
    discard(every)
    first = likely(members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), sets, percent)
    of = checkpointed(components(verified(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent)))
    large = members.where(F.col("size") > CROSS).select("key", "node")
    for turn in range(PIVOTS if large.take(1) else 0):
        own = apart(large, of, turn)
        pairs = own.where("of <> pivot.of").select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
        of = checkpointed(components(of.union(verified(likely(pairs, sets, percent), sets, percent))))
        large = own.select("key", "node")
    rest, very = members, members.where(F.col("size") > VERY).select("key", "node")
    if depth < DEPTH and very.take(1):
        again = rejoined(sets, checkpointed(apart(very, of, PIVOTS).select("node").distinct()), depth + 1)
        of = checkpointed(components(of.union(links(again, sets, percent, depth + 1))))
        discard(again)
        rest = members.where(F.col("size") <= VERY)
    rest = rest.select("key", "node")
    for forest in (True, False):
        own = apart(rest, of, PIVOTS)
        pairs = checkpointed(crossed(own, sets, percent, forest))
        more = verified(pairs.where("b IS NOT NULL"), sets, percent)
        if more.take(1):
            of = checkpointed(components(of.union(more)))
        keys = checkpointed(pairs.where("b IS NULL").select(F.col("a").alias("key")).distinct())
        if not keys.take(1):
            break
        rest = own.select("key", "node").join(hinted(keys), "key")
    discard(members)
    return of


def apart(members: DataFrame, of: DataFrame, turn: int) -> DataFrame:
    """(key, node, of, pivot) of the keys whose members are in several components `of`."""
    own = members.join(hinted(of.withColumnRenamed("component", "of")), "node", "left").withColumn("of", F.coalesce("of", "node"))
    several = own.groupBy("key").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.min_by(F.struct("node", "of"), F.xxhash64("node", F.lit(turn))).alias("pivot")).where("least <> most")
    return checkpointed(own.join(hinted(checkpointed(several.select("key", "pivot"))), "key"))


def grouped(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, node (its set) and group (the least node of its component)."""
    bounded_batches(docs.sparkSession)
    texts = texts_of(docs, "doc_id")
    hot, size = frequent(texts)
    for seed in itertools.count():
        rows = matched(texts, hot, seed, size)
        own = rows.where("n IS NOT NULL").select("doc_id", "n", "node", "y")
        classes = own.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n", "y")])
        classes = materialise(classes, "classes")
        if not rows.where("NOT enough").take(1) and not classes.where("min_n <> max_n OR min_y <> max_y").take(1):
            break
        discard(rows, classes)  # a set of too few segments, or two sets of one digest
    members = rows.where("n IS NULL").select("key", "node")
    wanted = classes.select("node", "doc_id").join(hinted(checkpointed(members.select("node").distinct())), "node")

    def make(part: pa.RecordBatch, pick) -> pa.RecordBatch:
        sets = shingle_sets(Words(col(part, "text")), SHINGLE)
        node = np.array([digest(s, seed)[0] for s in sets], np.int64)
        good = np.flatnonzero(pick(node, col(part, "doc_id").to_numpy(zero_copy_only=False)))
        good = good[np.unique(node[good], return_index=True)[1]].tolist()
        return sets_batch(node[good].tolist(), [sets[i] for i in good])

    sets = sets_of(texts, checkpointed(wanted), make)
    of = links(members, sets, percent)
    discard(sets)
    least = of.join(classes, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.select("node", "doc_id", "copies").join(of.join(least, "component"), "node", "left").where("copies > 1 OR component IS NOT NULL")
    named = checkpointed(named.select("node", F.coalesce("least", "doc_id").alias("least"), F.coalesce("component", "node").alias("group")))
    both = own.join(hinted(named), "node", "left")  # a set that very many rows have: adaptive execution splits its rows
    both = both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "node", F.coalesce("group", "node").alias("group"))
    both._seed = seed
    return both


def seed_of(groups: DataFrame) -> int:
    """The seed of the nodes of `grouped`."""
    return groups._seed


def with_nodes(docs: DataFrame, name: str, seed: int) -> DataFrame:
    """The documents with the node of each one's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            node = [digest(s, seed)[0] for s in shingle_sets(Words(col(part, "text")), SHINGLE)]
            yield pa.record_batch([*part.columns, pa.array(node, pa.int64())], [*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("long")).schema)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
