"""The registered corpus queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import (
    bpe,
    class_lm,
    compression_quality,
    decontaminate,
    periodic_runs,
    personal_data,
    quality_rules,
    shards,
    simhash,
    site_style,
    source_divergence,
    substring_dedup,
    toxicity,
)
from ashlar.llm.common import held_out, labelled, let
from ashlar.llm.sql import ORACLES as ORACLES  # with the queries, for whoever registers them

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(
        documents(spark, folder), tokenizer_path(), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"]
    )


def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(documents(spark, folder), ["doc_id"])
    return found.select("row.doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def _verdicts(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )


def op3(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows, _ = labelled(documents(spark, folder), labels, "toxic", toxicity.SAMPLE)
    model = toxicity.fit(rows, "doc_id", "text", "label")
    return _verdicts(toxicity.scored(documents(spark, folder), model, ["doc_id"]), 0.5)


def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = shards.shard(documents(spark, folder), [1.0] * 16, [1.0] * 17)
    return found.withColumn("law", F.lit("key"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows, counts = labelled(documents(spark, folder), labels, "quality", 2 * compression_quality.SAMPLE, by_class=True)
    share = counts.get(1, 0) / sum(counts.values()) if counts else None
    model = compression_quality.fit(rows, "doc_id", "text", "label", share=share)
    return _verdicts(compression_quality.scored(documents(spark, folder), model, ["doc_id"]), 0.3)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, folder), ["doc_id"], outputs=("kept_sha256",))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.found(documents(spark, folder), ["doc_id"])
    of_kind = [
        personal_data.number(F.col("base"), kind).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS
    ]
    return found.select(
        "row.doc_id",
        *of_kind,
        F.sha2(personal_data.written_out(F.col("base")), 256).alias("base_sha256"),
        personal_data.written_out(F.col("spans")).alias("spans"),
    )


def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), [])
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return site_style.main_text(pages, ["page_id", "url"])


def op10(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, folder), benchmark, ["doc_id"])


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text; where CRC-32 of the id is divisible by 10, its words from some place on repeat."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        start = (g % F.greatest(n, F.lit(1))).cast("int")
        period = (F.lit(1) + F.floor((n - start) / (3 + g % 8))).cast("int")
        return F.transform(words, lambda w, i: F.when(i < start, w).otherwise(F.get(words, start + (i - start) % period)))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & text.isNotNull(), F.array_join(let(words, repeated), " ")).otherwise(text)


def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    outputs = ("runs_sha256", "collapsed_sha256")
    found = periodic_runs.periodic(docs, ["doc_id"], outputs=outputs)
    return found.select("row.doc_id", "n_runs", "start", "length", "period", "exponent_milli", *outputs)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 1
    out = F.coalesce(held, F.lit(False))
    docs = documents(spark, folder).select("doc_id", "text", out.alias("held_out"))
    found = class_lm.scored(docs, ["doc_id", "held_out"], ~F.col("held_out"))
    return found.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_bpe_encode_decode": op1,
    "op2_quality_rules": op2,
    "op3_toxicity_ftrl": op3,
    "op4_rendezvous_shards": op4,
    "op5_compression_quality": op5,
    "op6_substring_dedup": op6,
    "op7_personal_data": op7,
    "op8_simhash_vp_trees": op8,
    "op9_site_style_tree": op9,
    "op10_decontaminate": op10,
    "op11_periodic_runs": op11,
    "op12_brown_class_lm": op12,
    "op13_source_divergence": op13,
}
