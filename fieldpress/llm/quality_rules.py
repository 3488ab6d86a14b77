"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document's metrics are made within its row. Per language and source, each metric is summed up in
a mergeable quantile sketch: counts of integer bins (per mille, or tenths of a character) of at most
`BINS` bins, so sketches of any rows merge by adding counts, on the map side first. A hot source is
therefore no more than `BINS` rows per task and metric. A group of fewer than `LEAST` documents takes
the merged sketch of its language. A document is rejected when a metric lies outside its group's
fence, quartile plus or minus `REACH` times the interquartile range and the metric's slack, or by the base rule.

Thresholds are one row per group: they are broadcast after a count, or joined with the hot groups
dealt out by a salt where there are more than `BROADCAST_GROUPS`.

Defined cases: null or empty text has no words and is rejected by the base rule; null language or
source is a group of its own; repeated rows each count and get the same verdict; an empty table gives
no rows; extra columns are kept as they are, and the added names replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldpress.llm.shared import checkpointed

WHITE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BINS, PRIOR, REACH, BROADCAST_GROUPS, SALTS = 1000, 50, 3, 100_000, 64
#: Metric: (numerator, denominator, factor), slack in its bins, and which sides are fenced.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, 30, "high"),
    "repeats": ("n_repeat_words", "n_words", 1000, 300, "high"),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 300, "high"),
    "word_length": ("word_chars", "n_words", 10, 15, "both"),
}


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once for all its uses."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    Each window is one long: its hash above its position, so that sorting lays equal windows side by
    side. The position takes bits from the hash, so windows whose neighbour has their hash are only
    candidates; these are sorted again by their words, and the positions of equal ones cover the words.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n))
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("long")))
        return bound(F.struct(F.sort_array(packed).alias("s"), bits.alias("bits")), lambda x: bound(positions(x["s"], x["bits"]), lambda p: bound(exact(w, p), covered)))

    def positions(s: Column, bits: Column) -> Column:
        key = lambda x: F.call_function("shiftright", x, bits)
        repeated = F.filter(s, lambda x, i: ((i > 0) & (key(F.get(s, i - 1)) == key(x))) | ((i < F.size(s) - 1) & (key(F.get(s, i + 1)) == key(x))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(mask)))

    def exact(w: Column, p: Column) -> Column:
        word = lambda i, k: F.get(w, (i + k).cast("int"))
        own = F.sort_array(F.transform(p, lambda i: F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("at"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return bound(own, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: ((i > 0) & same(F.get(s, i - 1), x)) | ((i < F.size(s) - 1) & same(F.get(s, i + 1), x))), lambda x: x["at"])))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.when(i == F.size(p) - 1, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), F.get(p, i + 1) - x)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(windows(words))


def measure(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"[^{WHITE}]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    count = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    without = lambda chars: F.length(F.translate(text, chars, "")).cast("long")
    found = F.struct(
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat"))).alias("w"),
        bound(lines, count).alias("l"),
    )
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    rest = [c for c in docs.columns if c not in own]
    made = docs.select(*[docs[c] for c in rest], found.alias("__found"), without(BLANKS).alias("word_chars"), (F.length(text).cast("long") - without(SYMBOLS)).alias("n_symbols"))
    f = F.col("__found")
    return made.select(*[made[c] for c in rest], f["w"]["n"].alias("n_words"), "word_chars", "n_symbols", f["l"]["dup"].alias("n_dup_lines"), f["w"]["repeat"].alias("n_repeat_words"), f["l"]["n"].alias("n_lines"))


def metric(name: str) -> Column:
    over, under, factor, _, _ = METRICS[name]
    return F.least(F.lit(BINS), F.expr(f"({factor} * {over}) div greatest(1, {under})")).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def group_of(df: DataFrame) -> list[Column]:
    return [F.coalesce(df[c].cast("string"), F.lit("\0")).alias(f"__{c}") for c in ("lang", "source")]


def sketches(measured: DataFrame) -> DataFrame:
    """(language, source, metric, bin, n): one mergeable sketch per group and metric."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("bin")) for m in METRICS])
    each = measured.select(*group_of(measured), F.explode(values).alias("v"))
    return each.groupBy("__lang", "__source", "v.metric", "v.bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per group: for each metric the lowest and the highest bin that is kept."""

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        upto = Window.partitionBy(*keys, "metric").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        all_of = Window.partitionBy(*keys, "metric")
        s = s.select(*keys, "metric", "bin", F.sum("n").over(upto).alias("at"), F.sum("n").over(all_of).alias("total"))
        of = lambda k: F.min(F.when(4 * F.col("at") >= k * F.col("total"), F.col("bin")))
        return s.groupBy(*keys, "metric").agg(of(1).alias("low"), of(3).alias("high"), F.max("total").alias("total"))

    own = quartiles(sketch, ["__lang", "__source"])
    merged = sketch.groupBy("__lang", "metric", "bin").agg(F.sum("n").alias("n"))
    wide = quartiles(merged, ["__lang"]).select("__lang", "metric", F.col("low").alias("wide_low"), F.col("high").alias("wide_high"))
    both = own.join(wide, ["__lang", "metric"])
    drawn = lambda c: F.expr(f"(total * {c} + {PRIOR} * wide_{c}) div (total + {PRIOR})")
    q = both.select("__lang", "__source", "metric", drawn("low").alias("low"), drawn("high").alias("high"))
    reach = REACH * (F.col("high") - F.col("low"))
    out = []
    for m, (*_, slack, sides) in METRICS.items():
        only = lambda x, m=m: F.max(F.when(F.col("metric") == m, x))
        out += [only((F.col("high") + reach + slack).cast("int")).alias(f"__{m}_most"), only((F.col("low") - reach - slack if sides == "both" else F.lit(0)).cast("int")).alias(f"__{m}_least")]
    return q.groupBy("__lang", "__source").agg(*out)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured documents with base_failed and kept."""
    rest = [c for c in measured.columns if c not in ("base_failed", "kept")]
    left = measured.select(*[measured[c] for c in rest], *group_of(measured))
    keys = ["__lang", "__source"]
    if limits.count() <= BROADCAST_GROUPS:
        both = left.join(F.broadcast(limits), keys, "left")
    else:
        salted = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rest if c == "doc_id"] or [F.lit(0)]), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], "left")
    inside = ~base_failed()
    for m in METRICS:
        inside &= metric(m).between(F.col(f"__{m}_least"), F.col(f"__{m}_most"))
    return both.select(*rest, base_failed().alias("base_failed"), F.coalesce(inside, F.lit(False)).alias("kept"))


def apply_rules(measured: DataFrame) -> DataFrame:
    """Sketch all rows, derive each group's fences, judge all rows; `measured` is read twice."""
    return judge(measured, checkpointed(fences(sketches(measured))))
