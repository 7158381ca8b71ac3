"""Corpus pipeline: language, quality, near-duplicates, packing, each stage on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, packing, quality, simhash
from factloom.llm.common import shared_folder, table
from factloom.llm.wordbpe import public_vocabulary

#: A document whose likeliest language has a smaller probability is rejected, like one without letters.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` under names that an operator's columns can't clash with, and the way back."""
    renamed = docs.toDF(*[f"in_{c}" for c in docs.columns])
    return renamed, lambda df: df.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null and letterless texts go.

    Repeated rows are judged alike; columns of any name stay as they are; an empty table gives an empty one.
    """
    vocabulary = public_vocabulary("piece_bpe_32k.model")
    model = langid.train(docs, vocabulary)
    own, back = _apart(docs)
    told = langid.identify(own, model, vocabulary, "in_doc_id", "in_text")
    return back(told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs.

    Good labelled texts are measured for the cutoffs, and every text where it stands, so that none is kept for later.
    Null and empty texts go, repeated rows are judged alike, an empty table gives an empty one.
    """
    (own, back), labels = _apart(docs), table(spark, sf_dir, "labels")
    holdout = quality.measure(quality.labelled_good(own, labels, "in_doc_id"), "in_text")
    cuts = quality.cutoffs(holdout, labels, "in_doc_id", "in_lang")
    return back(quality.verdicts(quality.measure(own, "in_text"), cuts, "in_lang").where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: 5-word shingles, Jaccard similarity 0.8.

    Null and wordless texts are copies of each other.  Rows that share an id are one document, and one of them stays;
    rows without an id all stay.  An empty table gives an empty one.
    """
    groups = simhash.near_duplicates(docs, words=5, similarity=0.8)
    first = groups.where("kept").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of at most 2048 tokens.

    A null text counts as empty and gives one piece, repeated rows give repeated pieces, an empty table none.
    """
    return packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and pack by tasks, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The STAGES over the whole documents, each one's result written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-pipeline-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
