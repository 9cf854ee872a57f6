"""Helpers that several corpus operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.session import stored

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of whole texts handed to Python at a time.
ARROW_ROWS = 1000
ARROW_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of whole texts to a size that fits a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that it is computed once and survives lost executors."""
    return stored(df, name)


#: Rows of two or three numbers that may be broadcast: some 50 MB in an executor.
BROADCAST_ROWS = 1_000_000


def matched(df: DataFrame, few: DataFrame, on: Column, how: str, rows: int | None = None) -> DataFrame:
    """Join with a saved table of narrow rows, which is broadcast only if its counted rows are within bounds."""
    n = few.count() if rows is None else rows
    return df.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, on, how)
