"""From raw documents to packed sequences: quality classifier, near-dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is
written as Parquet and read again for the next. The first three return the columns of
documents: rejected documents go, one document of each near-duplicate group stays
(five-word shingles, similarity 0.8), and the rest is repeated or dropped to the
targets of the sources. The last returns the place of every piece.

Tables may be empty, columns beside doc_id, text and source may have any names, and every
stage takes null ids, null texts and null sources, repeated rows and texts of any length: what
each does with them is said at its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import mixing, near_dedup, packing, quality
from loomgraph.llm.queries import tokenizer_path
from loomgraph.storage import stash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least the classifier's cut. A null text is judged as an empty one; ids play no part but to find labels."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts, that of the least id, and one more of its rows without an id; texts without words stay, once for an id."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them, up to three times; a null source is one of its own, rows with null or repeated ids draw for themselves."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row; rows that repeat have places of their own, a null text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", minhash_near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the sketches and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
