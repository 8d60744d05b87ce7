"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each as
Parquet to shared storage and reads it back for the next. All but the last return
the columns of documents. Null texts and null keys pass the filters: they can be
neither toxic, copies nor contaminated. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, packing, simhash, substring, toxicity
from lodestone.session import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity(docs.select(COLUMNS), labels).where("predicted = 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every near-duplicate class.

    Null and empty texts have one fingerprint, so one document of them stays. All
    rows of a doc_id stay or go together; rows without one stay.
    """
    copies = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(copies, "doc_id", "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier one holds; others keep their text as it is."""
    found = substring.dedup(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows.

    Null and empty texts stay. All rows of a doc_id go if one of them is contaminated; rows without one stay.
    """
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    bad = found.where(decontaminate.contaminated()).select("doc_id").distinct()
    return docs.select(COLUMNS).join(bad, "doc_id", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids. A null or empty text is its end id; repeated rows and null keys are packed row by row."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fingerprints, the classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
