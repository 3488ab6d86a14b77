"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
them with the columns of `documents`, the last one the packed pieces. A stage writes its decisions, a
small table, and returns its input without what they reject, so its result depends on its input and
that table alone; larger intermediate tables are removed before it returns. `run` writes each stage's rows
as Parquet to the folder that driver and executors share and reads them again as the next one's docs.

Defined cases of every stage: an empty table gives no rows; extra columns, whatever their names, keep
their values; repeated rows, null texts and null doc_ids are treated as each stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldpress.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from fieldpress.llm.shared import checkpointed, discard, fresh, hinted, materialise, table


def _digest(docs: DataFrame, *columns: str) -> Column:
    """A hash of a row's values; null and empty are told apart."""
    return F.xxhash64(*[x for c in columns for x in (docs[c].cast("string"), docs[c].isNull())])


def _without(docs: DataFrame, rejected: DataFrame, *columns: str) -> DataFrame:
    """The rows of `docs` that are not among `rejected` (doc_id, digest of these columns, or no digest at all)."""
    doc, h = fresh(docs.columns, "rejected_doc"), fresh([*docs.columns, "rejected_doc"], "rejected_h")
    gone = hinted(rejected.toDF(*[doc, h][: len(rejected.columns)]))
    same = docs["doc_id"].eqNullSafe(gone[doc])
    return docs.join(gone, same & (_digest(docs, *columns) == gone[h]) if columns else same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep. Null or empty text is rejected; repeated rows share a verdict."""
    seen = ("text", "lang", "source")
    plain = docs.select(docs["doc_id"], *[docs[c] for c in seen], _digest(docs, *seen).alias("digest"))
    measured = materialise(quality_rules.measure(plain).drop("text"), "measured")
    rejected = checkpointed(quality_rules.apply_rules(measured).where("NOT kept").select("doc_id", "digest").distinct())
    discard(measured)
    return _without(docs, rejected, *seen)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates, once; rows without words or doc_id stay.

    Of a doc_id with several rows the first row in the group stays, by its text's hash.
    """
    rows = jaccard_join.grouped(docs)
    found = materialise(rows.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "component_id", "node", "group"), "groups")
    repeated = checkpointed(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    dropped = checkpointed(found.where("doc_id <> component_id").select("doc_id").distinct().join(hinted(repeated), "doc_id", "left_anti"))
    kept = _without(docs, dropped)
    if repeated.take(1):
        names = docs.columns
        doc, node, rank = (fresh(names, c) for c in ("rows_doc", "rows_node", "rows_rank"))
        once = _without(kept, repeated)
        several = jaccard_join.with_nodes(kept.join(hinted(repeated.toDF(doc)), kept["doc_id"].eqNullSafe(F.col(doc)), "left_semi"), node, jaccard_join.seed_of(rows))
        own = found.select(F.col("doc_id").alias(doc), F.col("component_id").alias(f"{doc}_least"), F.col("node").alias(f"{doc}_node"), F.col("group").alias(f"{doc}_group")).distinct()
        both = several.join(own, (several["doc_id"] == own[doc]) & (several[node] == own[f"{doc}_node"]), "left")
        order = Window.partitionBy(f"{doc}_group").orderBy(several["doc_id"], F.xxhash64(several["text"]))
        first = F.col(f"{doc}_node").isNull() | ((several["doc_id"] == F.col(f"{doc}_least")) & (F.col(rank) == 1))
        kept = once.unionByName(both.withColumn(rank, F.row_number().over(order)).where(first).select(*[F.col(f"`{c}`") for c in names]))
    return kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; n_chars follows the text. Null texts and rows without a doc_id stay as they are."""
    names = docs.columns
    cut = substring_dedup.deduplicated(docs)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else cut[c] for c in names])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside any benchmark window. Null texts and null doc_ids stay."""
    names = docs.columns
    safe = docs.select("text", docs["text"].isNull().alias("kept_null"), *[docs[c].alias(f"kept_{i}") for i, c in enumerate(names) if c != "text"])
    found = decontamination.decontaminate(safe, table(spark, sf_dir, "benchmark"), keep=tuple(safe.columns)).where("NOT contaminated")
    return found.select(*[F.when(~F.col("kept_null"), F.col("text")).alias(c) if c == "text" else F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 1024 ids; null text is one end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: Tokens and passages are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        before, docs = docs, materialise(work(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # a stage's rows once the next one's are written
    return docs
