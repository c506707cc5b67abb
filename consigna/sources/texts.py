"""Texts: one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import is_blank
from consigna.schema import MAX_TEXT, TEXT_TOO_LONG

NO_TEXT = "No text content available for text mode parsing"


def _sizes(pages: DataFrame, max_chars: int) -> DataFrame:
    """Of each file whether its text can be gathered (`_fits`), and its error if not."""
    blank = ~F.coalesce("_any", F.lit(False))
    long = (F.col("_chars") - 1 > max_chars) | F.col("file_id").isNull()
    size = pages.groupBy("file_id").agg(
        F.sum(F.length("text") + 1).alias("_chars"),
        F.max(~is_blank(F.col("text"))).alias("_any"),
    )
    return size.select("file_id", (~blank & ~long).alias("_fits"), F.when(blank, F.lit(NO_TEXT)).when(long, F.lit(TEXT_TOO_LONG)).alias("error"))


def gathered_texts(pages: DataFrame, max_chars: int = MAX_TEXT) -> tuple[DataFrame, DataFrame]:
    """The texts of the files that have one which fits, and the errors of the others, told by lengths alone."""
    sizes = _sizes(pages, max_chars)
    texts = (
        pages.join(sizes.filter("_fits").select("file_id"), "file_id", "left_semi")
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct("page_idx", "text"))).alias("_pages"))
        .select("file_id", F.array_join(F.transform("_pages", lambda p: p["text"]), "\n", "").alias("text"))
    )
    return texts, sizes.filter(F.col("error").isNotNull()).select("file_id", "error")


def text_from_pages(pages: DataFrame, max_chars: int = MAX_TEXT) -> DataFrame:
    """Pages joined by a line feed in page order, with an error for files that have no usable text.

    The lengths are summed first, so only a file whose text fits one string is ever gathered. A
    longer one is an error, as it is for a single process.
    """
    texts, errors = gathered_texts(pages, max_chars)
    return texts.withColumn("error", F.lit(None).cast("string")).unionByName(
        errors.select("file_id", F.lit(None).cast("string").alias("text"), "error"))
