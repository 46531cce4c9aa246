"""A corpus pipeline: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and all but the last return the columns of documents.  Rows with a null doc_id
take part in every stage; stages that decide by id keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.llm import bpe, langid, mixing, secrets, similar, simhash
from strandtally.llm._shared import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; those without letters, with a posterior below one half, or told no better than byte by byte, go."""
    trees = langid.freeze(langid.context_counts(docs.where(~langid.held_out("doc_id", 4, 2))))
    return langid.recognised(docs, trees)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, once if its row is repeated (of different rows with one id, the first by text).

    Links are those of SimHash, and all others of a similarity of 0.8 or more of the sets of five-word shingles.
    """
    found = simhash.near_duplicates(docs, width=5)
    links = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    gone = similar.similar_components(docs, links).where("node <> root").select(F.col("node").alias("doc_id"))
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    named = kept.withColumn("_place", F.row_number().over(W.partitionBy("doc_id").orderBy("text", *rest))).where("_place = 1")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins the domains to the target weights; the leading domain stays whole."""
    rated = mixing.mix(docs.where("doc_id is not null"), table(spark, sf_dir, "labels"), most=1.0, anchor=True)
    kept = written(rated.where("copies > 0").select("doc_id").distinct(), "mixed")
    return docs.join(kept.hint("shuffle_merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; text is what the ids decode to."""
    coded = bpe.encode_decode(docs, bpe.default_vocabulary(), keep=("lang", "source", "n_chars"))
    return coded.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_duplicates),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed),
    ("BPE encoding and decoding", tokenised),
]

#: No stage can be stated in SQL as a whole; the tests compare near-dedup with brute force and tokens with the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
