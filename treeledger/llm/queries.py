"""The registered queries of the numbered operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.embedding_dedup import similar_vectors
from treeledger.llm.fingerprint import fingerprints
from treeledger.llm.language_id import languages
from treeledger.llm.line_dedup import without_shared_lines
from treeledger.llm.lm_scoring import language_model_scores
from treeledger.llm.minhash import near_duplicates
from treeledger.llm.mixing import mixed
from treeledger.llm.oracle import ORACLE_SQL
from treeledger.llm.packing import packed
from treeledger.llm.repeats import deduplicated
from treeledger.llm.token_counts import token_counts
from treeledger.llm.toxicity import toxicity
from treeledger.llm.vector_codes import coded
from treeledger.llm.whitening import whitened

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model_scores(_table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_shared_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(_table(spark, sf_dir, "embeddings"))[0]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_repeats": op2_repeats,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_minhash": op5_minhash,
    "op6_tokens": op6_tokens,
    "op7_fingerprint": op7_fingerprint,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_embeddings": op10_embeddings,
    "op11_lines": op11_lines,
    "op12_codes": op12_codes,
    "op13_whitening": op13_whitening,
}
