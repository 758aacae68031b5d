"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, folder of the tables) that works on all its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing, scratch

#: A document whose best language has a smaller mean probability is no running text in any of them.
LEAST_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; texts without a letter (null and empty ones too) and texts that fit no language go.

    Every row is judged by itself, whatever its id. An empty table stays empty.
    """
    langs, weights = language_id.fit(docs, ~language_id.held_out())
    rows = language_id.identify(docs, langs, weights, carry=[F.struct(*docs.columns).alias("row")])
    return rows.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def _repeats(docs: DataFrame) -> bool:
    """Whether an id comes twice."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup; of equal texts the one with the largest id stays, and of rows that repeat both, one.

    Rows that repeat an id with other texts stay each; a null text equals an empty one. An empty table stays empty.
    """
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (_digest() == kept["text_sha256"])
    left = docs.join(kept, same, "left_semi")
    return left.withColumn("text_sha256", _digest()).dropDuplicates(["doc_id", "text_sha256"]).drop("text_sha256") if _repeats(docs) else left


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join on five-word shingles at 0.8; of each linked group the row with the smallest id (then print of its text) stays.

    Rows that repeat an id are rows of their own; a null id is larger than any. Null texts and those without words link
    with nothing and stay. An empty table stays empty.
    """
    if not _repeats(docs):
        linked = jaccard_join.link_documents(docs, n=5, percent=80)
        gone = linked.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    # rows get names of their own: id and print of the text
    named = docs.withColumn("row_name", F.concat_ws(" ", F.col("doc_id").cast("string"), _digest()))
    linked = jaccard_join.link_documents(named, id_col="row_name", n=5, percent=80).select(F.col("doc_id").alias("name"), "component_id").distinct()
    rows = linked.join(named.select(F.col("row_name").alias("name"), "doc_id").distinct(), "name")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "name")
    kept = rows.groupBy("component_id").agg(F.min(rank)["name"].alias("kept_name"))
    return named.join(kept, named["row_name"] == kept["kept_name"], "left_semi").drop("row_name")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents with a passage of the benchmark go.

    Every row is judged by itself, whatever its id; null and empty texts stay. An empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens; a row per piece.

    Null texts count as empty; rows that repeat an id are packed each. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can't express the language model or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
