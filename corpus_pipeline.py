"""A corpus from raw documents to a training mix, in five stages.

``run`` writes each stage's result as parquet in the shared folder and rereads it for the next, so a lost executor
costs the stage at work alone.  Decisions take effect: later stages see only what earlier ones kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, read
from quaystone.llm.decontamination import clean_documents
from quaystone.llm.line_dedup import line_dedup
from quaystone.llm.minhash_forest import near_duplicates
from quaystone.llm.mixing import mix
from quaystone.llm.quality import fit_quality, keep_quality
from quaystone.sources.scratch import owned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the first stage is a fitted classifier.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    return keep_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more of them share; n_chars follows the text."""
    out = line_dedup(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    out = out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    match = docs["doc_id"].eqNullSafe(kept["doc_id"])
    return docs.join(kept.hint("shuffle_hash"), match, "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with owned():  # what the stage's operators stored goes once its result is
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
