"""Corpus pipeline: stages over `documents`, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
`documents`. No SQL gives the rows of a fitted classifier and of a packing, so ORACLE_SQL is None;
tests hold the rows of the first three stages against plain versions. Mixing and packing are held to
targets and kept texts by the tests of their operators only.

Defined results: a null or empty text scores 0 and goes in the first stage, unless there are no labels to learn
from (then nothing is rejected); further on it passes line dedup as it is, is linked with nothing and has size 0 in
mixing; in packing it is the end id alone. Rows with a null id are rows of
their own. Repeated rows are kept once by near-dedup. An empty table gives empty results; columns beyond those of
`documents` go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, cut
from tidemill.llm.line_dedup import without_lines
from tidemill.llm.minhash import drop_near_duplicates
from tidemill.llm.mixing import mix_documents
from tidemill.llm.packing import default_tokenizer, pack_documents
from tidemill.llm.quality_model import keep_quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below its threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return keep_quality(docs, labels)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and with them documents of which no word is left."""
    found = without_lines(docs)
    words = F.length(F.btrim(F.col("text"), F.lit(SPACES))) > 0
    changed = (F.col("_tm_exact") > 0) | (F.col("_tm_near") > 0)
    return found.filter(~changed | words).select(
        *[F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources brought to their targets; a document comes once for each copy taken."""
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("near-duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
