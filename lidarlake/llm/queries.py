"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.llm import (
    codes,
    collocations,
    decontaminate,
    jaccard,
    language_id,
    licenses,
    mixing,
    neighbours,
    quality,
    substrings,
    suffix_tree,
    toxicity,
    warc,
)
from lidarlake.llm.common import table
from lidarlake.session import fresh_path, stage


def _remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = licenses.default_templates(spark)
    found = licenses.scan(table(spark, sf_dir, "documents"), templates)
    return found.join(F.broadcast(templates.drop("text")), "template_id").select(
        "doc_id", "template_id", "license", "share"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_remainder(3) != 1))
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    scored = toxicity.score(docs, model, [F.col("doc_id"), held.alias("held_out")])
    return scored.select(
        "rest.doc_id", "rest.held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), _remainder(10) == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_remainder(5) != 0))
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    scored = quality.score(docs, model, [F.col("doc_id"), held.alias("held_out")])
    return scored.select(
        "rest.doc_id", "rest.held_out", "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted")
    )


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), carried=("vec_id", "label"))
    rows = stage(coded.select("rest.vec_id", "rest.label", "code", "error"), "codes")
    # A sum beyond 64 bits is null.
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256")
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = language_id.train(docs.where(_remainder(3) != 1).select("text", "lang"))
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    found = language_id.predict(docs, languages, [F.col("doc_id"), held.alias("held_out")])
    return found.select("rest.doc_id", "rest.held_out", "lang_pred", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_license_scan,
        op2_toxicity,
        op3_suffix_tree,
        op4_mixing,
        op5_decontamination,
        op6_nearest_neighbours,
        op7_substring_dedup,
        op8_warc,
        op9_jaccard_join,
        op10_quality,
        op11_code_compression,
        op12_language_id,
        op13_collocations,
    ]
    return {f.__name__: f for f in found}
