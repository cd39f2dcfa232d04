"""Column expressions over text that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word class of most contracts, and the ASCII letters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other capitals stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str = WORD) -> Column:
    """array<string>; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def computed_once(df: DataFrame) -> DataFrame:
    """df behind a generator, through which later filters are not pushed, so that its columns are not computed again for them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def row_key(id_col: str, text_col: str) -> Column:
    """A key by which results join back: a SHA-256 of id and text. Rows that share it are equal in both, so get equal results."""
    own = F.col(id_col).cast("string")
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.length(own), F.lit(-1)), own, F.coalesce(F.col(text_col), F.lit(""))), 256))
