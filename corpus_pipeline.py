"""A corpus through five stages: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) with docs as the stage before left them, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import decontaminate, line_dedup, mixing, near_copies, quality
from quillmesh.llm.common import new_path, table, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, learnt from labels of these documents, doesn't predict as 1."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs.select(*COLUMNS), weights)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; n_chars is counted anew where lines went."""
    docs = docs.select(*COLUMNS)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    changed = F.col("n_dropped") > 0
    return kept.select(
        "_row.doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("_row.text")).alias("text"),
        "_row.lang",
        "_row.source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("_row.n_chars")).alias("n_chars"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id.

    Rows are told apart by id and text, so null and repeated ids lose no row that is not a copy; of rows alike in both the least stays.
    """
    key = ["_none", "_d", "_k"]

    def keyed(df: DataFrame, text: Column) -> DataFrame:
        return df.withColumns({"_none": F.col("doc_id").isNull(), "_d": F.coalesce("doc_id", F.lit(0)), "_k": text})

    one = keyed(near_copies.representatives(docs), F.col("text_key")).select(*key)
    kept = keyed(docs.select(*COLUMNS), text_key()).join(one, key, "left_semi")
    return kept.groupBy(*key).agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with items of benchmark."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: (doc_id, source, size, source_size, target, copies, taken) of documents of which it takes a copy or more."""
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sizes(sizes).where("copies > 0")


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("mixing", mix)]

#: The classifier's scores and the fingerprints can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
