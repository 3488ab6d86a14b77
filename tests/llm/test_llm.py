"""Each corpus operator against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fieldpress.llm import bytewords, catalog, chat, components, decontamination, jaccard_join, lm_scoring, matching, packing, pieces, quality_classifier, quality_rules, shared, substring_dedup, token_counts, token_output
from fieldpress.llm.shared import scratch

BPE, PIECES = catalog.vocabulary("byte_bpe_50k.json"), catalog.vocabulary("piece_bpe_32k.model")
#: Columns whose names the operators use inside.
CLASH = {"n_words": 1, "key": 2, "node": 3, "a": 4, "b": 5, "salt": 6, "kept": 7, "rid": 8, "n": 9, "tail": 10, "component": 11, "part": 12, "x": 13, "held_out": 14}
SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """(doc_id, text) rows with the other columns of documents and clashing ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", None if i is None else "s", len(t or ""), *CLASH.values()) for i, t in rows], schema)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def edges():
    base = prose(1, 120)
    long = prose(2, 30_000, 5000)
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, long), (9, long), (10, "Ünï cödé é " * 40), (None, base), (11, prose(3, 90) + "\n" + prose(4, 70)), (12, prose(4, 70) + "\n" + prose(5, 90)), (13, "<|endoftext|> <s> x")]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, edges()).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -99")


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return SPACE.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_byte_words():
    for t in (*[x or "" for _, x in edges()], "A\x0bB\x1cc\x85 d"):
        w = bytewords.Words(pa.array([t, "", t]))
        n = len(words(t))
        assert w.bounds.tolist() == [0, n, n, 2 * n] and [w.text(i).decode() for i in range(n)] == words(t)
        assert (w.hash[:n] == w.hash[n:]).all() and len(set(w.hash[:n].tolist())) == len(set(words(t)))
    assert [len(s) for s in bytewords.shingle_sets(bytewords.Words(pa.array([x for _, x in edges()])))] == [len(shingles(x)) for _, x in edges()]


@pytest.mark.parametrize("path", [BPE, PIECES, catalog.vocabulary("word_bpe_49k.json")])
def test_pieces_equal_the_library(path):
    r = random.Random(7)
    texts = [x or "" for _, x in edges()] + ["".join(r.choice("ab'sé ▁\n\t\r.,1<|> ÿ×　日") for _ in range(r.randint(0, 30))) for _ in range(800)]
    e = pieces.Encoder(path)
    flat, bounds = e.ids(pa.array(texts))
    want = e.whole(texts)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert e.counts(pa.array(texts)).tolist() == [len(x) for x in want]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs, nothing):
    got = rows(packing.pack(docs, BPE, with_ids=True))
    want = collections.Counter((i, tuple(ids_of(t))) for i, t in edges())
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == crc(r["ids"]) and len(r["ids"]) == r["length"]
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(r["ids"])))
    for v in by_seq.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 1024
    for (doc, n), v in by_doc.items():
        copies = sum(c for (i, t), c in want.items() if i == doc and len(t) == n)
        whole = next(t for i, t in want if i == doc and len(t) == n)
        assert sum(len(x) for _, x in v) == n * copies and all(whole[s : s + len(x)] == x for s, x in v)
    assert {(i, len(t)) for i, t in want} == set(by_doc)
    assert packing.pack(nothing, BPE).count() == 0


def test_differencing_is_near_equal():
    r = random.Random(0)
    for n, k in ((40, 7), (100, 30), (5, 9), (3, 1), (64, 2)):
        sizes = [r.randint(1, 256) for _ in range(n)]
        dealt = packing.differencing(sizes, k)
        assert sorted(i for w in dealt for i in w) == list(range(n)) and len(dealt) <= k
    sizes = [r.randint(1, 256) for _ in range(512)]
    sums = [sum(sizes[i] for i in w) for w in packing.windows(sizes)]
    assert max(sums) <= 1024 and len(sums) <= math.ceil(sum(sizes) / 1024) * 1.02 + 1
    assert packing.windows([]) == [] and packing.cut(1024) == [1024] and sum(packing.cut(2500)) == 2500


def test_token_output(spark, docs, nothing):
    uri = scratch(spark, "t")
    manifest = token_output.write_tokens(docs, BPE, uri, length=64)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows(token_output.read_tokens(spark, manifest, uri)))
    want, at = [], 0
    for i, t in sorted(edges(), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = ids_of(t)
        want.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    shard = manifest.first()
    s = token_output.Shard(token_output.folder(uri)[0], shard.file)
    ids, mask = s.sequence(0)
    assert len(ids) == len(mask) == 64 and all(mask.to_pylist()) and ids.base is not None
    empty = scratch(spark, "t")
    assert token_output.read_tokens(spark, token_output.write_tokens(nothing, BPE, empty), empty).count() == 0


def test_token_counts(spark, docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t in edges())
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.count_tokens(docs, PIECES, 50)))
    assert got == want and token_counts.count_tokens(nothing, PIECES).count() == 0


def brute_rules(text):
    text = text or ""
    w = SPACE.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_quality_rules(spark, docs, nothing):
    hard = [(20, "a b c " * 60), (21, "# $ % & | < > *\n" * 30), (22, prose(9, 100) + "\n" + "same line here\nsame line here\n same line here"), (23, "x y x y x y z"), (24, "a b c d a b c")]
    both = docs.unionByName(frame(spark, hard))
    got = rows(quality_rules.apply_rules(quality_rules.measure(both)))
    assert len(got) == len(edges()) + len(hard) and {"lang", "key", "salt"} <= set(got[0])
    key = lambda r: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
    assert sorted((str(r["doc_id"]), key(r)) for r in got) == sorted((str(i), brute_rules(t)) for i, t in edges() + hard)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.apply_rules(quality_rules.measure(nothing)).count() == 0


def test_quality_fences_reject_what_stands_out(spark):
    clean = [(i, prose(100 + i, 150)) for i in range(300)]
    odd = [(1000 + i, " ".join(w + "###" for w in words(prose(500 + i, 150)))) for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in rows(quality_rules.apply_rules(quality_rules.measure(frame(spark, clean + odd))))}
    assert not any(got[i] for i, _ in odd) and sum(got[i] for i, _ in clean) >= 298


def test_quality_thresholds_are_a_sources_own(spark):
    """The same symbols stand out in a source that has none, and not in one that is full of them."""
    marked = lambda i: " ".join(w + "##" for w in words(prose(i, 150)))
    rows_of = [(i, prose(100 + i, 150), "plain") for i in range(400)] + [(1000 + i, marked(2000 + i), "marked") for i in range(400)] + [(5000, marked(7), "plain"), (5001, marked(8), "marked"), (5002, marked(9), "new")]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows_of], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in rows(quality_rules.apply_rules(quality_rules.measure(docs)))}
    assert not got[5000] and got[5001] and got[5002] and sum(got[1000 + i] for i in range(400)) >= 396


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_leaks(text, items):
    w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        v = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_decontamination(spark, docs, nothing, most):
    base = prose(1, 120).split(" ")
    items = [(1, " ".join(base[20:45])), (2, "ONE, two three"), (2, "one"), (10, None), (11, ""), (12, prose(77, 200)), (13, " ".join(base[30:40])), (14, " ".join(base[5:14])), (15, "Ünï cödé é ünï")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(30, prose(60, 40) + " " + " ".join(prose(77, 200).split()[50:60]) + " tail"), (31, " ".join(prose(77, 200).split()[50:59]))]
    both = docs.unionByName(frame(spark, extra))
    got = rows(decontamination.decontaminate(both, bench, most=most))
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
    assert sorted(map(key, got)) == sorted((str(i), *brute_leaks(t, items)) for i, t in edges() + extra)
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontamination.decontaminate(docs, bench.where("item_id < 0"))))


def brute_links(texts, percent=80):
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def variants(seed, n, copies, edits):
    """A base text and copies with some words changed, around the limit."""
    r = random.Random(seed)
    base = words(prose(seed, n, 5000))
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.random()}"
        out.append(" ".join(w))
    return out


def test_jaccard_join(spark, docs, nothing):
    texts = [t for k, (n, edits) in enumerate([(6, 1), (12, 1), (30, 2), (60, 3), (100, 6), (300, 14), (900, 40), (2500, 90)]) for t in variants(k, n, 12, edits)]
    extra = [(100 + i, t) for i, t in enumerate(texts)]
    both = docs.unionByName(frame(spark, extra))
    got = rows(jaccard_join.near_duplicates(both))
    want = brute_links(edges() + extra)
    text = dict(edges() + extra)
    assert len(got) == len(edges()) + len(extra)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["n_shingles"] == len(shingles(text[r["doc_id"]])) for r in got)
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_sketch_bound_and_keys():
    r = np.random.default_rng(3)
    a = np.sort(bytewords.mix(r.integers(0, 1 << 63, 500, dtype=np.uint64)))
    b = np.sort(np.concatenate((a[40:], bytewords.mix(r.integers(0, 1 << 63, 30, dtype=np.uint64)))))
    apart = np.bitwise_count(jaccard_join.sketch(a).view(np.uint64) ^ jaccard_join.sketch(b).view(np.uint64)).sum()
    assert apart <= 70
    none = np.zeros(0, np.uint64)
    for hot in (none, a[::2]):
        x, y = (jaccard_join.join_keys(t, hot, 0) for t in (a, b))
        assert set(x[0].tolist()) & set(y[0].tolist()) and x[1] and y[1]


def test_links_that_a_star_misses(spark):
    """Two members of a key that are like each other, but not like the key's smallest."""
    tokens = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 50, 55)]
    sets = spark.createDataFrame([(i, 100, jaccard_join.sketch(t).tolist(), t.tobytes()) for i, t in enumerate(tokens)], "node long, n long, sketch array<long>, tokens binary")
    members = spark.createDataFrame([(k, i) for k in (7, 8) for i in (0, 1, 2, 1)], "key long, node long")
    assert {(r.node, r.component) for r in jaccard_join.links(members, sets).collect()} == {(1, 1), (2, 1)}


@pytest.fixture
def other_ways(monkeypatch):
    """Every bound on what is broadcast, held or tested at once so low that the way beyond it is taken."""
    for module, name, value in (
        (shared, "BROADCAST_ROWS", -1), (jaccard_join, "BROADCAST_BYTES", -1), (jaccard_join, "UNIT", 2), (jaccard_join, "CROSS", 3), (jaccard_join, "VERY", 4), (quality_rules, "BROADCAST_GROUPS", -1), (lm_scoring, "HEAD", 300), (lm_scoring, "NEAR", 1),
    ):
        monkeypatch.setattr(module, name, value)


def test_jaccard_join_the_other_way(spark, docs, other_ways):
    texts = [t for k, (n, edits) in enumerate([(12, 1), (60, 3), (300, 14)]) for t in variants(50 + k, n, 12, edits)]
    hub = words(prose(99, 200, 5000))  # unlike documents that share half of their words, some of them alike
    texts += [" ".join(hub[:100] + words(prose(700 + i // 3, 100, 5000))) for i in range(15)]
    extra = [(100 + i, t) for i, t in enumerate(texts)]
    got = rows(jaccard_join.near_duplicates(docs.unionByName(frame(spark, extra))))
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_links(edges() + extra)


def test_jaccard_join_of_a_doc_id_with_two_texts(spark):
    a, b = words(prose(70, 80, 5000)), words(prose(71, 80, 5000))
    docs = frame(spark, [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a + ["plus"])), (3, " ".join(b + ["plus"])), (4, prose(72, 80, 5000))])
    got = sorted((r["doc_id"], r["component_id"]) for r in rows(jaccard_join.near_duplicates(docs)))
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = rows(corpus_pipeline.near_duplicates(spark, docs.unionByName(frame(spark, [(1, " ".join(a))])), ""))
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, prose(72, 80, 5000))])


def test_matching_of_entries():
    e = matching.Entries(4, ["u8", "i8"], 1, 2)
    e.add(np.array([5, 5, 5, 6, 7], np.uint64), np.array([1, 2, 2, 3, 4]))
    sent = [r for b in e.out() for r in b.to_pylist()]
    ready = [tuple(x.tolist()) for r in sent if r["kind"] == 1 for x in e.unpacked(r["blob"])]
    assert ready == [(5, 5), (1, 2)]
    own = {r["part"]: r["blob"] for r in sent if r["kind"] == 2}
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*map(e.unpacked, own.values()), strict=True)), strict=True)) == [(5, 1), (6, 3), (7, 4)] and set(own) == {1, 2, 3}
    other = matching.packed([np.array([5, 9], np.uint64), np.array([8, 8])])
    assert [c.tolist() for c in e.joined([own[1], own[1], other])] == [[5, 5], [1, 8]]
    dealt = [pa.record_batch([pa.array([0, 0, 1], pa.int32()), pa.array([2, 1, 2], pa.int32()), pa.array([b"a", b"b", b"c"], pa.binary())], schema=matching.SENT)]
    assert list(matching.parts_in_order(iter(dealt), {2})) == [(1, [b"b"]), (2, [b"a"]), (2, [b"c"])]


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)] + [(9, 9)]
    want = components.stars([a for a, _ in links], [b for _, b in links])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert {k: v for k, v in got.items() if k != v} == want
    many = components.components(spark.createDataFrame(links, "u long, v long").repartition(7), held=40)
    assert {r.node: r.component for r in many.collect()} == got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_dedup(spark, docs, nothing):
    passage = prose(900, 60, 3000).replace("\n", " ")
    near = words(prose(901, 80, 3000))
    other = list(near)
    other[40] = "changed"
    extra = [(50, prose(902, 100) + " " + passage + " " + prose(903, 40)), (51, "Start " + prose(904, 33) + " " + passage), (52, prose(905, 50) + "\n" + " ".join(near)), (53, " ".join(other) + "\n" + prose(906, 50)), (54, prose(907, 200, 5000)), (55, passage)]
    both = docs.unionByName(frame(spark, extra))
    got = rows(substring_dedup.repeated(both))
    found = {r["doc_id"] for r in got}
    assert {1, 2, 8, 9, 11, 12, 50, 51, 52, 53, 55} <= found and not found & {3, 4, 5, 6, 7, 54, None}
    assert all(50 in r["source_doc_ids"] for r in got if r["doc_id"] in (51, 55))
    clean = substring_dedup.deduplicated(both)
    assert clean.columns == both.columns
    texts = {r["doc_id"]: r["text"] for r in rows(clean)}
    assert passage in texts[50] and passage not in texts[51] and texts[54] == extra[4][1] and texts[3] is None and texts[8] == edges()[8][1]
    assert len(words(texts[51])) < 34 + 24 and len(words(texts.get(55, ""))) < 24 and len(words(texts[53])) <= 50
    assert rows(clean.where("doc_id IS NULL"))[0]["text"] == edges()[11][1]
    assert substring_dedup.repeated(nothing).count() == 0 and substring_dedup.deduplicated(nothing).count() == 0


def test_short_repeats_are_found_and_stay(spark):
    line = " ".join(f"licence{i}" for i in range(20))
    docs = frame(spark, [(i, prose(920 + i, 60, 9000) + "\n" + line + "\n" + prose(940 + i, 60, 9000)) for i in range(3)])
    got = rows(substring_dedup.repeated(docs))
    assert {r["doc_id"] for r in got if r["n_words"] >= 20} == {0, 1, 2} and all(r["removed_words"] == 0 for r in got)
    assert substring_dedup.repeated(docs, least=substring_dedup.RUN).count() == 0
    assert all(line in r["text"] for r in rows(substring_dedup.deduplicated(docs)))


def test_wrapped_near_copy_of_a_block(spark):
    words_of = [f"word{i}" for i in range(160)]
    changed = [f"other{i}" if i in (44, 114) else x for i, x in enumerate(words_of)]
    wrap = lambda x, n: "\n".join(" ".join(x[i : i + n]) for i in range(0, len(x), n))
    docs = frame(spark, [(1, prose(960, 30, 9000).replace("\n", " ") + "\n\n" + wrap(words_of, 8)), (2, prose(961, 30, 9000).replace("\n", " ") + "\n \n" + wrap(changed, 9)), (3, wrap(words_of[:30], 6))])
    got = {r["doc_id"]: r for r in rows(substring_dedup.repeated(docs)) if r["doc_id"] == 2}
    assert got[2]["n_words"] == 160 and got[2]["removed_words"] == 160
    p = substring_dedup.Lines(pa.array(["a b c d e\nf g h i j\n\nk l m n o", "", "p q r s t\n\t\nu v w x y\nz"]))
    assert sorted(zip(p.text.tolist(), p.first.tolist(), p.size.tolist(), strict=True)) == [(0, 0, 5), (0, 0, 10), (0, 5, 5), (0, 10, 5), (2, 15, 5), (2, 20, 5), (2, 20, 6)]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_bands_miss_no_more_than_20_of_5(similarity):
    assert (1 - similarity**substring_dedup.ROWS) ** substring_dedup.BANDS <= (1 - similarity**5) ** 20


def shared_runs(texts, least):
    """By brute force: (doc, first, words) of the maximal runs of at least `least` words that another document has too."""
    tokens = {i: words(t) for i, t in texts}
    at = collections.defaultdict(set)
    for i, w in tokens.items():
        for k in range(len(w) - least + 1):
            at[tuple(w[k : k + least])].add(i)
    out = []
    for i, w in tokens.items():
        hit = [len(at[tuple(w[k : k + least])]) > 1 for k in range(len(w) - least + 1)]
        k = 0
        while k < len(hit):
            if hit[k]:
                end = k
                while end < len(hit) and hit[end]:
                    end += 1
                out.append((i, k, end - k + least - 1))
                k = end
            k += 1
    return out


@pytest.mark.parametrize("way", ["own", "other"])
def test_repeats_against_brute_force(spark, request, way):
    """Planted passages and near copies of lines among other words: what is shared is found, and nothing else."""
    if way == "other":
        request.getfixturevalue("other_ways")
    r = random.Random(8)
    plain = lambda seed, n: words(prose(seed, n, 20_000))
    texts, near = [], []
    for i in range(60):
        w = plain(5000 + i, 150)
        if i % 3 == 0:
            k, n = r.randrange(60), r.choice([60, 70, 90])
            w[100:100] = plain(6000 + i // 6, 100)[k % 10 : k % 10 + n]
        text = " ".join(w)
        if i % 5 == 1:
            line = plain(7000 + i // 10, 140)
            line[r.randrange(20, 120)] = f"changed{i}"
            text, near = text + "\n" + " ".join(line), [*near, (i, len(w))]
        texts.append((i, text))
    got = rows(substring_dedup.repeated(frame(spark, texts).repartition(5)))
    covered = collections.defaultdict(set)
    for x in got:
        covered[x["doc_id"]] |= set(range(x["first_word"], x["first_word"] + x["n_words"]))
    runs = shared_runs(texts, 51)
    assert len(runs) >= 15 and all(len(covered[i] & set(range(a, a + n))) >= n - 2 * substring_dedup.PANE for i, a, n in runs)
    assert len(near) == 12 and sum(set(range(a, a + 140)) <= covered[i] for i, a in near) >= 0.9 * len(near)
    tokens = {i: words(t) for i, t in texts}
    five = collections.Counter(g for i, w in tokens.items() for g in {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert not covered.keys() - {i for i, w in tokens.items() if any(five[tuple(w[k : k + 5])] > 1 for k in range(len(w) - 4))}


def test_deduplication_of_a_doc_id_with_two_texts(spark):
    passage = " ".join(words(prose(80, 90, 9000)))
    rest = [" ".join(words(prose(81 + i, 90, 9000))) for i in range(3)]
    docs = frame(spark, [(1, passage), (2, rest[0] + "\n" + passage), (2, rest[1]), (3, passage + "\n" + rest[2])]).withColumnRenamed("rid", "removed_doc").withColumnRenamed("x", "Removed_Spans")
    got = {(r["doc_id"], r["text"], r["removed_doc"], r["Removed_Spans"]) for r in rows(substring_dedup.deduplicated(docs))}
    assert got == {(1, passage, 8, 13), (2, rest[0] + "\n" + passage, 8, 13), (2, rest[1], 8, 13), (3, rest[2], 8, 13)}


def test_without_words():
    assert substring_dedup.without("a b c d e f", [(1, 3)]) == "a d e f" and substring_dedup.without("a b c", [(0, 3)]) == ""
    assert substring_dedup.without("a b c d e f", [(0, 1), (4, 5)]) == "f"


@pytest.mark.parametrize("text", ["<|im_end|><|im_start|>assistant ok", "", "\n", "a\n", "\na", "<\\|im_end|>", "assistant\n", "<|im_end|>\n<|im_start|>assistant\n", "<", "\\n"])
def test_chat_template_reads_back(text):
    turns = [("system", "s"), ("user", text), ("assistant", text), ("assistant", text + "x"), ("odd\nrole\\", text)] * 30
    out = list(chat.rendered(chat.chatml, turns))
    full = "".join(s for s, _, _ in out)
    assert full == chat.chatml(turns) and chat.parse(full) == turns
    assert [chat.unescape(s[a:b]) for (s, a, b), (r, _) in zip(out, turns, strict=True) if r == "assistant"] == [t for r, t in turns if r == "assistant"]


def test_chat_template_that_rewrites_history():
    with pytest.raises(chat.RewritesHistory):
        list(chat.rendered(lambda turns: "".join(t for _, t in reversed(turns)), [("user", "a"), ("assistant", "b")]))


def test_chats(spark):
    table = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (1, 1, "assistant", "b", 0), (None, 0, "assistant", "é", 0), *[(3, i, "user" if i % 2 else "assistant", f"t{i}", 0) for i in range(500)]]
    conv = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in rows(chat.format_chats(chat.with_added(spark, conv)))}
    for c in (1, 2, None, 3):
        own = sorted((t, r or "", x or "") for i, t, r, x, _ in table if i == c)
        said = "".join(x for _, r, x in own if r == "assistant")
        full = chat.chatml([(r, x) for _, r, x in own])
        assert got[c] | {"conv_id": c} == {"conv_id": c, "n_turns": len(own), "turns_sha256": hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), "loss_chars": len(said), "loss_sha256": hashlib.sha256(said.encode()).hexdigest(), "formatted_chars": len(full)}
    assert got[-1]["loss_chars"] == 34 and chat.format_chats(conv.where("conv_id = 99")).count() == 0


def test_classifier_learns(spark, docs, nothing):
    made = [(i, prose(i, 60) if i % 3 else " ".join(["spam"] * 20 + words(prose(i, 30)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in made] + [(999_999, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    both = frame(spark, made)
    got = rows(quality_classifier.classify(both, labels))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert len(quality_classifier.classify(docs, labels).collect()) == len(edges()) and quality_classifier.classify(nothing, labels).count() == 0
    assert {r["score"] for r in rows(quality_classifier.classify(docs, labels.where("doc_id < 0")))} == {0.5}


def test_lm_scores(spark, docs, nothing):
    def base(table, got):
        counts = collections.Counter()
        texts = collections.defaultdict(list)
        for i, t in table:
            w = [*words(t), "\0"]
            texts[i].append(w)
            if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
                counts.update(w)
        n, z = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
        for r in got:
            w = next(x for x in texts[r["doc_id"]] if len(x) == r["n_tokens"])
            assert r["train_tokens"] == n and r["n_known"] == sum(counts[x] > 0 for x in w)
            assert r["base_score"] == pytest.approx(sum(math.log10(counts[x] + 0.5) - z for x in w), abs=1e-6)
            assert r["score"] <= 1e-6

    base(edges(), rows(lm_scoring.score_documents(docs)))
    pairs = [f"p{k} q{k}" for k in range(60)]
    r = random.Random(1)
    table = [(i, " ".join(r.choice(pairs) for _ in range(80))) for i in range(400)]
    got = rows(lm_scoring.score_documents(frame(spark, table)))
    base(table, got)
    held = [x for x in got if x["held_out"]]
    assert held and sum(x["score"] for x in held) > 0.8 * sum(x["base_score"] for x in held)  # a pair's second word follows from its first
    assert lm_scoring.score_documents(nothing).count() == 0
    assert {x["score"] for x in rows(lm_scoring.score_documents(docs.where("doc_id IS NULL")))} == {0.0}


def random_model(rows=1 << 12):
    r = np.random.default_rng(0)
    n = 3000
    head, counts, shapes = bytewords.randoms(n, 9), np.arange(n, 0, -1), r.integers(0, lm_scoring.REST * lm_scoring.SLOTS, n)
    mass = np.bincount(shapes, counts + 0.5, lm_scoring.REST * lm_scoring.SLOTS)
    m = lm_scoring.Model(int(counts.sum()), n, head, counts, shapes, mass, rows)
    m.w[:], m.v[:] = r.normal(size=m.w.shape), r.normal(size=m.v.shape)
    return m, head, counts, shapes


def test_model_is_a_distribution():
    m, head, counts, shapes = random_model()
    f = lm_scoring.features(head[:1], np.array([0, 1]))
    slots = np.arange(lm_scoring.CLASSES * lm_scoring.SLOTS)
    p = np.exp(lm_scoring.log_chances(m, slots, np.repeat(f, len(slots), axis=1)))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    core = lm_scoring.CORE * lm_scoring.SLOTS
    within = np.bincount(shapes[core:], counts[core:] + 0.5, lm_scoring.REST * lm_scoring.SLOTS) + 0.5  # tokens of a shape, and one never seen
    assert np.exp(np.log(within) - m.log_mass) == pytest.approx(1)
    assert sorted(m.targets(head[:core], shapes[:core])) == list(range(core)) and (m.targets(head[core:], shapes[core:]) == core + shapes[core:]).all()


def test_log_chances_against_one_token_at_a_time():
    m, head, _, shapes = random_model()
    r = np.random.default_rng(5)
    pick = r.integers(0, len(head), 200)
    h, s, bounds = head[pick], shapes[pick], np.array([0, 0, 70, 200])
    got = lm_scoring.log_chances(m, m.targets(h, s), lm_scoring.features(h, bounds))
    mask = (1 << 64) - 1
    one = lambda x: int(bytewords.mix(np.array([x & mask], np.uint64))[0])
    for i in range(len(h)):
        start = max(b for b in bounds.tolist() if b <= i)
        before = [int(h[i - k]) if i - k >= start else int(lm_scoring.START) for k in (1, 2)]
        f = [one(x + k * 0x9E3779B9) for k, x in enumerate([*before, one(before[0] * 3 + before[1])])]
        t = int(m.targets(h[i : i + 1], s[i : i + 1])[0])
        c, want = t // lm_scoring.SLOTS, 0.0
        for table, bias, own, keys in ((m.w, m.bias, c, f), (m.v, m.slot_bias[c], t % lm_scoring.SLOTS, [((x ^ ((c + 1) * 0x9E3779B97F4A7C15 & mask)) * 0xD6E8FEB86659FD93) & mask for x in f])):
            z = bias.astype(np.float64) + sum(table[k >> 52].astype(np.float64) for k in keys)
            want += z[own] - np.log(np.exp(z - z.max()).sum()) - z.max()
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_lm_scores_the_other_way(spark, docs):
    key = lambda df: sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows(df))
    want = key(lm_scoring.score_documents(docs))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_scoring, "HEAD", 300)
        m.setattr(lm_scoring, "NEAR", 1)
        assert key(lm_scoring.score_documents(docs)) == want


def test_lm_tables_grow_with_the_vocabulary():
    sizes = [lm_scoring.Model(n, n, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(lm_scoring.REST * lm_scoring.SLOTS)).rows for n in (10, 5000, 20_000, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == lm_scoring.ROWS_LEAST < sizes[1] < sizes[-1] == lm_scoring.ROWS_MOST


def test_pipeline_against_brute_force(spark, tmp_path):
    clean = [(i, prose(2000 + i, 130, 3000)) for i in range(40)]
    leak = prose(3000, 40, 3000)
    passage = " ".join(words(prose(3001, 80, 3000)))
    table = [*clean, (100, clean[0][1]), (101, "a b " * 80), (102, prose(3002, 100, 3000) + "\n" + leak), (103, prose(3003, 100, 3000) + "\n" + passage), (104, passage + "\n" + prose(3004, 100, 3000)), (105, None), (106, "short")]
    frame(spark, table).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, near, repeats, leaks = kept
    assert set(quality) == {i for i, _ in table} - {101, 105, 106}
    assert set(near) == set(quality) - {100}
    assert set(repeats) == set(near) and [i for i in near if near[i] != repeats[i]] == [104] and passage not in repeats[104]
    assert set(leaks) == set(repeats) - {102}
    mixed = frame(spark, table).withColumnRenamed("a", "__hit").withColumnRenamed("b", "__gone").withColumnRenamed("x", "n_hit").withColumnRenamed("rid", "digest")
    extra = [c for c in mixed.columns if c not in docs.columns]
    for (name, stage), texts in zip(corpus_pipeline.STAGES[:-1], kept, strict=True):  # columns of clashing names keep their values
        mixed = stage(spark, mixed, str(tmp_path)).cache()
        back = mixed.collect()
        assert {r.doc_id: r.text for r in back} == texts and {tuple(r[c] for c in extra) for r in back} == {tuple(CLASH[{"__hit": "a", "__gone": "b", "n_hit": "x", "digest": "rid"}.get(c, c)] for c in extra)}, name
    got = rows(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)))
    assert sum(r["length"] for r in got) == sum(len(ids_of(t)) for t in leaks.values()) and {r["doc_id"] for r in got} == set(leaks)


def test_chat_rewrites_far_back_are_refused():
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(100)]

    def shortens(turns):  # from turn 40 on, turns 2 to 9 are left out
        return "".join(f"{r}:{t};" for i, (r, t) in enumerate(turns) if len(turns) <= 40 or not 2 <= i < 10)

    def numbered(turns):
        return "".join(f"{i}.{r}:{t};" for i, (r, t) in enumerate(turns))

    with pytest.raises(chat.RewritesHistory):
        list(chat.rendered(shortens, turns))
    assert "".join(s for s, _, _ in chat.rendered(numbered, turns)) == numbered(turns)


def test_repeat_words_of_a_very_long_text(spark):
    once = frame(spark, [(1, " ".join(map(str, range(30_000_000, 30_000_000 + (1 << 21) - 1)))), (2, "a b c d a b c e")])
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows(quality_rules.measure(once))} == {1: 0, 2: 6}


def test_stages_do_not_depend_on_each_other(spark, tmp_path):
    table = frame(spark, [(i, prose(2000 + i, 130, 3000)) for i in range(30)] + [(50, None), (None, prose(1, 120))])
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        once, again = stage(spark, table, str(tmp_path)), stage(spark, table, str(tmp_path))
        assert once.count() == again.count() == once.count()
        assert stage(spark, table.where("doc_id = -9"), str(tmp_path)).count() == 0
    left = rows(corpus_pipeline.benchmark_leaks(spark, table, str(tmp_path)))
    assert {r["doc_id"]: r["text"] for r in left} == {r["doc_id"]: r["text"] for r in rows(table)}
