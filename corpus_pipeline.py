"""The corpus pipeline: each stage works on all documents that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the next
stage's documents. All stages but the last return the columns of ``documents``.

Defined cases, those of the operators: a null text counts as empty, so documents without text are one group of copies, of which one
stays. Rows without an id take part, are never trained on, and sort last where the smallest id stays; of rows given twice one stays.
Without labels nothing is toxic and all documents form one domain, each once. Other columns pass through whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from measura.llm import toxicity
from measura.llm.common import materialize, table
from measura.llm.exact_dedup import drop_copies
from measura.llm.mixing import apply_rates
from measura.llm.packing import pack_documents
from measura.llm.queries import TARGETS, domains_of, tokenizer_path
from measura.llm.simhash import drop_near_copies


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on labelled documents, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected words by domain meet the target shares; none is dropped."""
    return apply_rates(docs, domains_of(docs, table(spark, sf_dir, "labels")), TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has no string kernels, XXH64, projected gradients or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
