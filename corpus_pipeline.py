"""Five stages from raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. run() writes what a stage returns as Parquet and reads it again for the next.
All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import packing, quality, secrets, similar, substring
from tidewater.llm.common import columns_of, materialize, row_key, table


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where documents have it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; it is fit on the labelled ones outside the test fold.

    A null or empty text is scored like any other, by zero statistics, and mostly goes. Equal
    texts score alike, so repeated rows stay or go together; a null doc_id is never learned
    from. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~quality.held_out(F.col("doc_id"), 5, 0))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts whose five-word shingles are alike by 0.8 or more.

    The covering tables of op1 and bands of minimum hashes give pairs, which are compared
    exactly. The smallest doc_id of a group stays, of rows that repeat it the one with the
    smallest hash, and of wholly equal rows one. Null, empty and blank texts are one group; a
    group whose ids are all null keeps one row. All columns are kept; an empty table gives an
    empty result.
    """
    return similar.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing is left goes too.

    A passage of 50 words or more stays in the document with the smallest doc_id only. Rows of
    one doc_id, repeated rows too, never cut each other, and rows with a null doc_id neither
    cut nor are cut. Null texts stay null, texts without words stay; a text that loses words
    has the others joined by one space, and n_chars follows it. All columns are kept; an
    empty table gives an empty result.
    """
    cut = substring.deduplicate(docs).where("cut.n_words = 0 or cut.n_removed < cut.n_words")
    kept = cut.select(*(F.col("cut.kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
    return _recounted(kept).select(*columns_of(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [SECRET]; no document goes, and n_chars follows the text.

    Each row is scanned by itself, so ties, repeated rows and null ids change nothing; a null
    text stays null. All columns are kept; an empty table gives an empty result.
    """
    return _recounted(secrets.redact(docs)).select(*columns_of(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence; no sequence holds two of a source or near-duplicate group.

    The columns are those of packing.PACKED. A null source conflicts with nothing, a null or
    empty text is one piece without words, a long text is cut into full pieces and a rest,
    and repeated rows are packed like any others. An empty table gives an empty result.
    """
    keep = {"source": F.col("source"), "n_tokens": packing.count_words(F.col("text"))} | dict(zip(("k1", "k2"), row_key(F.col("doc_id"), F.col("text")), strict=True))
    return packing.pack(similar.near_duplicates(docs, keep=keep).withColumnRenamed("component_id", "cluster"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Fitted trees, hashes of shingles and best fit are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
