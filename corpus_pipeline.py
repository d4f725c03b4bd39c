"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``:

1. quality classifier: documents that the boosted trees, fitted on the labelled documents, reject go;
2. line dedup: repeated passages go from texts from their first to their last line, and a document that
   consists of them goes;
3. n-gram Jaccard join: one row of each group of near duplicates stays, that with the smallest id, and of
   rows with the same id and text one;
4. secret scan: secrets are replaced by a mark;
5. best-fit packing: the pieces of all texts with their places in sequences.

Null and empty texts pass the stages as far as their scores allow; a row without doc_id stands for a group
only if no row of the group has one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import Scratch, table
from transpark.llm.line_dedup import dedup_lines
from transpark.llm.ngram_join import ngram_components
from transpark.llm.packing import JSON, added_tokens, pack, pieces
from transpark.llm.quality import fit_quality, score_quality
from transpark.llm.secret_scan import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs.select(*COLUMNS), passages=True)
    left = out.where((F.col("n_removed") == 0) | (F.trim("deduped") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("deduped").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("deduped").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are linked by a number of their own, so that repeated and missing ids are told apart
    rows = Scratch(spark, "rows").write(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    group = ngram_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(group, "_row").groupBy("component_id").agg(F.min(place)["_row"].alias("_row"))
    kept = rows.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)
    # texts without shingles are in no group; of those with the same id one stays
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, added=added_tokens(public_tokenizers.path(JSON))))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Trained scores, repeated passages and components are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage's output is a Parquet table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i + 1 == len(STAGES) else scratch.write(out, f"stage{i + 1}")
    return docs
