"""The registered queries of the corpus operators, and their SQL where SQL can express them.

Each applies its operator with production parameters to whole tables and
derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import annulus, chat_format, chosen_path, fertility, fill_middle, licenses, line_dedup, mixing, nn_descent, piece_viterbi, secrets, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = [public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    # bands come from labelled rows that are not held out; the verdict is over all
    learned = _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return fertility.fertility(_table(spark, sf_dir, "documents"), vocabularies, labels=learned)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_viterbi.digest(piece_viterbi.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_text=False))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_chats(chat_format.with_probe(_table(spark, sf_dir, "conversations"))))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.plan(_table(spark, sf_dir, "documents")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(_table(spark, sf_dir, "embeddings")).drop("recall", "audited_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "toxic")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.digest(annulus.cluster(_table(spark, sf_dir, "embeddings")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_middle(_table(spark, sf_dir, "documents")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_tokeniser_fertility, op2_sentencepiece, op3_minhash_near_dedup, op4_chat_format, op5_license_scan,
        op6_mix_sources, op7_embedding_near_dedup, op8_line_dedup, op9_toxicity, op10_token_counts,
        op11_centroid_clustering, op12_fill_middle, op13_secret_scan,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minhash_near_dedup": chosen_path.SQL, "op4_chat_format": chat_format.SQL, "op5_license_scan": licenses.sql(), "op7_embedding_near_dedup": nn_descent.SQL, "op8_line_dedup": line_dedup.SQL,
        "op11_centroid_clustering": annulus.sql(), "op12_fill_middle": fill_middle.SQL, "op13_secret_scan": secrets.sql(),
    }
