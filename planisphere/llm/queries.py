"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, decontaminate, language, line_dedup, middle, mixing, near_dedup, privacy, quality, token_counts, url_trust, yinyang
from .common import table
from .sql import ORACLES

_CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trust.judge(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op3_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_prefix_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(hard))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", decode=audio.render)


def op11_lazy_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = middle.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.report(yinyang.fit(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, str(public_tokenizers.path("word_bpe_49k.json"))).drop("text")


_ALL = (op1_link_trust, op2_containment, op3_zstd_quality, op4_entropy_mix, op5_centroid_language, op6_bbit_minhash, op7_prefix_chat, op8_line_runs, op9_disclosure_pii, op10_chroma_prints, op11_lazy_middle, op12_yinyang, op13_token_counts)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
