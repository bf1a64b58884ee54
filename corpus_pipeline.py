"""From raw documents to packed sequences: language, near copies, repeats, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import jaccard, langid, packing, secrets, suffixes
from chatloom.llm.common import fold, fresh, row_key, table
from chatloom.llm.queries import tokenizer

#: Bytes of a passage that counts as repeated: a little below fifty short words.
PASSAGE = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text, without letters, or in no learned language: those
    that list far fewer of their n-grams than the language's own texts do, whatever the
    number of languages.  Texts too short to judge stay.  The model is learned from the
    given table, not from what is left of it."""
    given = table(spark, sf_dir, "documents")
    model = langid.fit(given.where(fold() != 1).select("text", "lang"))
    judged = langid.predict(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & F.col("fits")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near copies: the smallest by id (null
    last), then by a hash of the text; of repeated rows, the smallest by all columns.
    Rows without words are in no group and stay."""
    from chatloom.session import durable

    row = fresh(docs.columns, "row")
    linked = durable(jaccard.link(docs).where("component is not null").select("doc_id", "row", "component"))
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = linked.join(first.select("component", "first.row", F.lit(True).alias("stays")), ["component", "row"], "left")
    gone = gone.where("stays is null").select(F.col("row").alias(row)).distinct()
    # Rows of equal id and text share a key; they are brought down to one by aggregation.
    often = linked.groupBy(F.col("row").alias(row)).count().where("count > 1").select(row)
    kept = docs.withColumn(row, row_key("doc_id", "text")).join(gone, row, "left_anti")
    once = kept.join(often, row, "left_anti").select(*docs.columns)
    # Cut off first, so that a hot key's rows may be split and are combined before they are dealt out.
    repeated = durable(kept.join(often, row, "left_semi")).groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("first"))
    return once.unionByName(repeated.select("first.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of `PASSAGE` bytes or more that also stand elsewhere.  A document
    whose whole text goes stays, as an empty text; null texts stay null."""
    return suffixes.without_repeats(docs, length=PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, also encoded ones.  Null texts stay null, empty ones empty."""
    return secrets.redact_table(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is one closing id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("secrets", masked), ("packing", packed)]

#: Gram filters, suffixes and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the given documents, each stage's rows cut off from the one before."""
    from chatloom.session import durable

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
