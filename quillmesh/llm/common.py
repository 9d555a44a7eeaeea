"""What the operators of this subpackage share: words, row keys, joins with tables that may be small.

Arrow batches keep the session's bounds, 10,000 rows and 64 MB unless set otherwise; no operator changes a setting.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path, written  # noqa: F401

#: Rows of a table of a few dozen bytes each that may be broadcast, after they were counted.
BROADCAST_ROWS = 100_000
#: A-Z and a-z, for lower-casing ASCII alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as none: what Python workers get, without decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_key(column: str = "text") -> Column:
    """With doc_id it tells rows apart that share a doc_id; rows alike in both give the same results."""
    return F.xxhash64(F.lit(11), F.col(column))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df, computed once, marked for broadcast if it has at most BROADCAST_ROWS rows; else Spark shuffles for it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
