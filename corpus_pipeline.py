"""A corpus from raw documents to piece ids, in five stages of the corpus operators.

Every stage works on all its predecessor kept and is written and read again
before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import chosen_path, line_dedup, mixing, piece_viterbi, toxicity
from skyweave.llm.shared import Scratch


def _beside(docs: DataFrame, taken: set[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply(docs)`` with the columns of ``docs``; its own columns of the names ``taken`` are put aside meanwhile."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in taken}
    out = apply(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold of their language."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _beside(docs, {"score", "predicted", "toxic"}, lambda own: toxicity.score(own, model).where(~F.col("toxic")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without lines that the corpus has earlier; n_chars follows the text."""
    own = _beside(docs, {"n_lines", "n_dropped"}, line_dedup.dedup_lines)
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return own.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of least id; rows without an id stay."""
    return chosen_path.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every draw of the mix."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    return piece_viterbi.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A trained classifier and near-duplicate search have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
