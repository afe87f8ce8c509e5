"""The corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, tokens.

Each stage works on all that the one before it kept. All but the last return the columns of documents;
the last adds the token ids, their number, and whether they decode to the text.

Defined results, stage by stage: a null or empty text goes in the second stage, which no text under its
number of words passes; a null doc_id is kept by the third and is an id like others for the fourth, a null lang
or source loses nothing; very long texts are treated whole; equal rows become one in the third stage, ties
there keep the least doc_id; the fourth repeats documents and drops none; rows are in its order after it; columns
that documents has beside those needed pass through all stages, whatever their names, unless they are called
ids, n_tokens or round_trip, which the last replaces; an empty table, or one of which a stage keeps nothing,
gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, divergence_rules, hyperminhash, mixing, nbsvm
from tessera.llm.shared import Scratch, collected, table

#: Hashing, fitted models and connected components: the stages are tested by brute force and held-out rows.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, accepts."""
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return nbsvm.keep_good(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a language reference of the corpus."""
    return divergence_rules.keep_good(docs, divergence_rules.reference(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return hyperminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources read as often as their target weights ask for, every document at least once."""
    return mixing.mix(docs, budget="cover", repeats=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; round_trip says whether these decode to the text."""
    done = bpe.encode(docs, check_col="round_trip")
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    return done.select(*own, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written to the shared folder and read again,
    and what the stage and the one before it left there is deleted. Runs beside this one keep theirs."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with collected() as made:
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        for used in made:
            used.clear()
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
