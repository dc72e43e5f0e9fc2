"""Training-corpus pipeline: five stages, each over all that the one before kept.

quality rules -> line dedup -> SimHash and shingle near-dedup -> benchmark decontamination -> SentencePiece ids.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents`. Stages behave as their operators document for nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, line_dedup, pieces, quality_rules, shingles
from tallyloom.llm.common import checked_broadcast, materialize, table
from tallyloom.llm.queries import piece_model, with_trust

#: SQL has no spaced seeds, fingerprints or piece lattice; tests hold the stages against brute force.
ORACLE_SQL = None


def _row(docs: DataFrame) -> Column:
    """Names a document by its id and its text, so that null and repeated ids stay apart."""
    return F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"], docs["text"].isNull(), docs["text"])


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` without the rows named in `rows`(gone)."""
    return docs.join(checked_broadcast(materialize(rows.select("gone").distinct(), "gone")), _row(docs) == F.col("gone"), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose mean n-gram ratio reaches the threshold."""
    ratios = quality_rules.fit_ratios(with_trust(spark, docs, sf_dir), F.col("trusted"))
    columns = docs.columns
    return quality_rules.apply_rules(docs, ratios, keep=tuple(columns)).where("kept").select(*columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that loses all its words goes."""
    done = line_dedup.dedup_lines(docs)
    stays = (F.size("dropped_lines") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return done.where(stays).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, null ids last.

    Groups are linked by five-word shingles or by fingerprints; a document in several rows stays in one.
    """
    found = materialize(shingles.groups(docs, _row(docs)), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    least = found.groupBy("group").agg(F.min(order)["row"].alias("stays"), F.count("*").alias("c")).where("c > 1").select("group", "stays")
    linked = found.join(checked_broadcast(materialize(least, "near-least")), "group")
    kept = _without(docs, linked.where("row <> stays").select(F.col("row").alias("gone")))
    repeated = materialize(linked.where("row = stays").groupBy("row").agg(F.count("*").alias("c")).where("c > 1").select(F.col("row").alias("gone")), "near-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(checked_broadcast(repeated), _row(kept) == F.col("gone")).dropDuplicates(["gone"]).drop("gone")
    return _without(kept, repeated).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    rows = docs.select(_row(docs).alias("doc_id"), "text")
    return _without(docs, decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, ready for training, with the score of the best segmentation."""
    encoded = pieces.encode(docs, piece_model(), keep=("doc_id", "lang", "source", "n_chars"))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", F.get("paths", 0)["score"].alias("score"), "round_trip")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontamination_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
