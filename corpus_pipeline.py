"""The corpus pipeline: five stages over ``documents``, each one of the operators.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``:

1. ``quality_rules`` drops the documents that the rules reject;
2. ``jaccard_join`` keeps one document, that of the smallest id, of each group of
   near copies (5-word shingles, 80 %); documents without words and without an id
   link with nothing and stay; of rows that repeat both id and text the one whose
   other columns come first, written as JSON, stays;
3. ``pii`` replaces personal data by pseudonyms;
4. ``mix_sources`` repeats and leaves out documents so that sources come near
   their weights, dealt to shards and shuffled inside them;
5. ``pack`` returns pieces in sequences of 2048 tokens.

Empty tables pass through; columns beyond those of ``documents`` are carried to
the last stage. SQL cannot express the random draws of stage 4 or a tokenizer, so
``ORACLE_SQL`` is None and the tests hold each stage against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.llm import jaccard_join, mixing, packing, pii, quality_rules
from loomline.llm.queries import pii_key, vocabulary_path
from loomline.session import stage

# Near copies share four fifths of their shingles of five words; op4's query keeps its own contract.
NEAR_PERCENT, NEAR_WORDS = 80, 5
# Prefixes of a fifth make pairs of all near copies: longer lists are compared around pivots.
SHORT_LISTS = 8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs.withColumn("_text", F.struct(*[f"`{c}`" for c in docs.columns])))
    return judged.filter("kept").select("_text.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    joined = jaccard_join.join_similar(docs, percent=NEAR_PERCENT, size=NEAR_WORDS, heavy=SHORT_LISTS,
                                       counted=False)
    kept = stage(joined.filter("doc_id = component_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows")), "kept")
    once = docs.join(kept.filter("rows = 1"), "doc_id", "left_semi")
    # Only rows of ids that repeat are compared, by their text's digest.
    again = docs.join(kept.filter("rows > 1"), "doc_id", "left_semi")
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    first = again.groupBy("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).agg(
        F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(docs.filter("doc_id IS NULL"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms."""
    return pii.pseudonymize(docs, pii_key(spark)).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_each),
    ("pii", hide_personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
