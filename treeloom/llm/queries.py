"""The queries of the training-data operators: one op<N>_<name> for each, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprints, hard_negatives, language, neighbours, ngram_join, odd_sketches, oracles, packing, pieces, pii, substring_dedup, suffix_dedup, toxicity
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.Likeness(words=3, percent=90)).select("doc_id", "n_shingles", "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketches.classes(table(spark, sf_dir, "documents"), odd_sketches.Likeness(words=4, percent=80)).select("doc_id", "n_shingles", "component_id", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_nearest_neighbours, op4_ngram_join, op5_personal_data, op6_suffix_dedup, op7_substring_dedup, op8_fingerprints, op9_language, op10_best_fit_packing, op11_collocations, op12_minhash_dedup, op13_hard_negatives)}
ORACLES = {"op4_ngram_join": oracles.NGRAM_JOIN, "op7_substring_dedup": oracles.SUBSTRING_DEDUP, "op11_collocations": oracles.COLLOCATIONS, "op12_minhash_dedup": oracles.ODD_SKETCHES, "op13_hard_negatives": oracles.HARD_NEGATIVES}
