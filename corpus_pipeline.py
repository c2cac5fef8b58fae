"""A training corpus out of raw documents: five operators of lidarlake.llm, one after another.

Each stage takes what its predecessor kept, decides on all of it, and returns the columns of
documents; the last adds ``taken``. A doc_id may be missing or repeat: what a stage decides holds
for a row, or for rows of one doc_id and text, told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.llm import decontaminate, jaccard, mixing, substrings, toxicity
from lidarlake.llm.common import table
from lidarlake.session import stage


def _texts_in_small_batches(spark: SparkSession) -> None:
    """Rows are whole texts, some of them long: fewer than Spark's 10,000 go to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than 0.7; it learns from this stage's labelled rows."""
    _texts_in_small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    others = [F.col(c) for c in docs.columns if c != "text"]
    scored = toxicity.score(docs, model, others, text=True).where("score < 0.7")
    return scored.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, the key of a doc_id and text; a missing doc_id has keys too."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text", F.col("doc_id").isNull()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at Jaccard 0.8 on five-word shingles, the document of least doc_id.

    A missing doc_id comes last; of several texts with the least doc_id, one stays.
    Rows that repeat a kept document's id and text count as one. Documents without words are
    linked with nothing and stay, each row of them if the doc_id is missing.
    """
    _texts_in_small_batches(spark)
    keyed = _keyed(docs)
    linked = jaccard.jaccard_join(keyed.select(F.col("_row").alias("doc_id"), "text"), k=5, num=80, den=100)
    linked = linked.select(F.col("doc_id").alias("_row"), "component_id", (F.col("n_shingles") == 0).alias("_empty")).distinct()
    names = keyed.select("_row", F.col("doc_id").alias("_id")).distinct()
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_row", "_empty")
    least = linked.join(names, "_row").groupBy("component_id").agg(F.min(order).alias("least"))
    kept = least.select(F.col("least._row").alias("_kept"), (F.col("least.last") & F.col("least._empty")).alias("_each"))
    each = F.when(F.col("_each"), F.monotonically_increasing_id()).otherwise(-1)
    rows = keyed.join(kept, F.col("_row") == F.col("_kept")).withColumn("_copy", each)
    return rows.dropDuplicates(["_row", "_copy"]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of any passage of 35 words or more that occurs elsewhere too.

    A text that loses nothing stays as it is; ``n_chars`` follows a text that changes.
    """
    _texts_in_small_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    cut = substrings.remove_repeats(docs, window=35, carried=others, whole=True)
    # Renamed by place: a carried name may be one of the results'.
    cut = cut.toDF(*[f"c{i}" for i in range(len(others))], "n_words", "n_removed", "kept")
    at = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("kept")}
    changed = F.when(F.col("n_removed") > 0, F.length("kept").cast("long"))
    if "n_chars" in at:
        at["n_chars"] = F.coalesce(changed, at["n_chars"])
    return cut.select(*[at[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with up to a fifth of its words edited."""
    _texts_in_small_batches(spark)
    keyed = _keyed(docs)
    texts = keyed.select(F.col("_row").alias("doc_id"), "text")
    found = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark"))
    gone = stage(found.select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes words of, each with ``taken``, the number of words taken of it."""
    _texts_in_small_batches(spark)
    others = [c for c in docs.columns if c != "taken"]
    mixed = mixing.mix(docs, carried=others).where("taken > 0")
    return mixed.select(*[F.col("rest").getField(c).alias(c) for c in others], "taken")


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("source_mixing", mixture),
]

#: No SQL states a trained classifier or a seeded choice; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
