"""The registered queries of this subpackage: thin, each over its whole table, with its operator's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import avi, chat, decontaminate, line_dedup, mixing, quality, sharding, simhash, substring_dedup, suffix_tree, surrogates, target_encoding, turn_repair
from .common import EMPTY_SHA, remainder, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sizes(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, parsed by a model learnt from those whose crc32(conv_id) mod 4 is not 2."""
    raw = chat.observe(chat.transcripts(table(spark, sf_dir, "conversations")))
    held_out = F.coalesce(remainder("conv_id", 4) == 2, F.lit(False))
    parsed = chat.parse(raw, chat.fit(raw.where(~held_out)))
    sizes = [F.size("lines").alias("n_lines"), chat.agreement(parsed).alias("n_agree"), F.size("turns").alias("n_found")]
    return parsed.select("conv_id", "part", held_out.alias("held_out"), "n_turns", *sizes, "chat")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: For tests and comparisons of runs only: whoever reads this can undo surrogates made with it.
TEST_KEY = b"only for tests: set spark.quillmesh.surrogates.key"


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of spark.quillmesh.surrogates.key, or TEST_KEY where it is unset."""
    found = spark.conf.get("spark.quillmesh.surrogates.key", None)
    return found.encode() if found else TEST_KEY


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.checked(surrogates.anonymise(table(spark, sf_dir, "documents"), surrogate_key(spark)))
    return found.select("doc_id", "text", F.size("spans").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"), "n_clashes")


def op10_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = target_encoding.encoded(*(table(spark, sf_dir, n) for n in ("sale_lines", "sales", "items", "vendors", "clients")))
    return found.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", *[f"{c}_{x}" for c in ("item", "vendor", "client") for x in ("n", "rate")])


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of as many rows."""
    found = sharding.sharded(table(spark, sf_dir, "documents"), 8, stored=True)
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    sizes = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    return found.select("row.doc_id", *sizes, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those that lost all turns too."""
    rows = table(spark, sf_dir, "conversations")
    fixed = turn_repair.repair(turn_repair.damaged(rows))
    key = lambda c: [F.col(c).isNull().alias("_none"), F.coalesce(c, F.lit(0)).alias("_conv")]
    every = rows.select("conv_id").distinct().select("conv_id", *key("conv_id"))
    found = fixed.conversations.select(*key("conv_id"), *[c for c in fixed.conversations.columns if c != "conv_id"])
    hashes = turn_repair.digests(fixed.turns).select(*key("conv_id"), "repaired_sha256")
    out = every.join(found, ["_none", "_conv"], "left").join(hashes, ["_none", "_conv"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


OPERATORS = (op1_quality, op2_simhash, op3_mixing, op4_substring_dedup, op5_chat, op6_suffix_tree, op7_decontaminate, op8_line_dedup, op9_surrogates, op10_avi, op11_target_encoding, op12_sharding, op13_turn_repair)
QUERIES: dict[str, Query] = {f.__name__: f for f in OPERATORS}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
