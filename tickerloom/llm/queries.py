"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, mixing, ngram_join, oracles, packing, private, repeats, resampling, toxicity, urls, vantage, voronoi, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int) -> Column:
    """Remainder of the crc32 of the document's id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_fold(3) == 1, F.lit(False)))
    return language.with_language(docs, docs.where("not held_out"), ["doc_id", "held_out"])


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.voronoi_top_k(_table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(chat.chat_segments(rows.union(extra)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, _table(spark, sf_dir, "labels"), ["doc_id"]).withColumn("held_out", F.coalesce(_fold(5) == 0, F.lit(False)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(_table(spark, sf_dir, "pages"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with score and prediction, learned from the labels of ``docs``: folds 1 to 3 of
    5 are counted, fold 4 is fitted on, fold 0 stays out."""
    labels = labels.select("doc_id", "toxic")
    return toxicity.with_toxicity(docs, labels.where(_fold(5).isin(1, 2, 3)), toxicity.fit_labels(labels.where(_fold(5) == 4)), keep, text_col)


def op7_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.vantage_top_k(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resampled(docs, _table(spark, sf_dir, "benchmark").select("text"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_source_mix": op3_source_mix,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_vantage_point_search": op7_vantage_point_search,
    "op8_packing": op8_packing,
    "op9_personal_data": op9_personal_data,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES = oracles.ORACLES
