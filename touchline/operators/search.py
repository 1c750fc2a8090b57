"""Three-letter pieces of names, the table that stands for a trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigrams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and each distinct trigram of the words of ``text``, padded by two blanks before and one after.

    Bucket or partition the table by trigram to look names up by equality instead of a scan.
    Null and empty texts have none.
    """
    words = df.select(*keys, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("w")).filter("w != ''")
    padded = words.select(*keys, F.concat(F.lit("  "), "w", F.lit(" ")).alias("p"))
    starts = F.sequence(F.lit(1), F.length("p") - 2)
    return padded.select(*keys, F.explode(F.transform(starts, lambda i: F.substring("p", i, F.lit(3)))).alias("trigram")).distinct()


def similar(index: DataFrame, keys: list[str], query: str, least: float = 0.3) -> DataFrame:
    """Names that share trigrams with ``query``: ``keys`` and similarity, shared over all trigrams."""
    spark = index.sparkSession
    wanted = trigrams(spark.createDataFrame([(1, query)], "q int, t string"), ["q"], "t").select("trigram")
    n = wanted.count()
    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shared = index.join(F.broadcast(wanted), "trigram").groupBy(*keys).agg(F.count(F.lit(1)).alias("s"))
    return shared.join(sizes, keys).select(*keys, (F.col("s") / (F.col("n") + n - F.col("s"))).alias("similarity")).filter(F.col("similarity") >= least)
