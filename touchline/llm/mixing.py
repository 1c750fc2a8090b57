"""Problem 7: sources mixed to target shares of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More sources than this in the table of targets are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 10_000


def mixing_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source: source, target_share, max_repeats, tokens_available, n_docs, rate.

    ``sizes`` has (source, n_tokens), ``targets`` (source, target_share, max_repeats). The rate is
    how often each document of a source is used: the tokens due to the source over those it has,
    at most max_repeats. Without ``total_tokens`` the mixture is the largest in which no source
    needs more repeats than it may have, so that all shares are reached; with it, a source that
    would need more is repeated max_repeats times, and its share falls short.

    Shares are taken relative to their sum over the sources that have tokens. A source with no
    tokens, share or repeats has rate 0; null shares and repeats count as 0; a source named twice
    in the targets counts once, with its largest share and repeats. A null source matches no target.
    """
    have = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"), F.count(F.lit(1)).alias("n_docs"))
    wanted = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"),
    )
    both = wanted.join(have, "source", "left").fillna(0, ["tokens_available", "n_docs"])
    live = (F.col("tokens_available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    reach = F.when(live, F.col("tokens_available") * F.col("max_repeats") / F.col("target_share"))
    limit = both.agg(F.min(reach).alias("r"), F.sum(F.when(live, F.col("target_share"))).alias("s")).first()
    if limit is None or limit["r"] is None:
        rate = F.lit(0.0)
    else:
        scale = limit["r"] if total_tokens is None else total_tokens / limit["s"]  # tokens for a share of one
        due = F.lit(float(scale)) * F.col("target_share") / F.col("tokens_available")
        rate = F.when(live, F.least(due, F.col("max_repeats").cast("double"))).otherwise(0.0)
    # a rate that is a whole number but for rounding is that number
    near = F.abs(rate - F.round(rate)) < 1e-9
    return both.withColumn("rate", F.when(near, F.round(rate)).otherwise(rate))


def mix(sizes: DataFrame, rates: DataFrame, id_col: str, seed: int = 1) -> DataFrame:
    """The mixture: one row (``id_col``, source, copy int from 1, n_tokens) per use of a document.

    A document is used floor(rate) times, and once more with a probability of the fraction: where
    a hash of its id, size and the seed, as a number in [0, 1), is below it. The same documents
    come out in every run. Sources without a target are left out by definition of the mixture.
    Repeated rows of one id get the same decision each. Nothing is shuffled: the rates are one
    row per target, broadcast where there are at most 10,000 of them.
    """
    few = rates.filter(F.col("rate") > 0).select(F.col("source").alias("__tl_source"), "rate")
    few = F.broadcast(few) if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else few
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col("n_tokens")), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate").cast("int")
    uses = whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0)
    used = sizes.join(few, F.col("source") == F.col("__tl_source")).withColumn("__tl_uses", uses).filter("__tl_uses > 0")
    return used.select(id_col, "source", F.explode(F.sequence(F.lit(1), F.col("__tl_uses"))).alias("copy"), "n_tokens")


def mixing_report(mixture: DataFrame, rates: DataFrame) -> DataFrame:
    """Shares really reached: the rates' columns, tokens_used long, n_used long, actual_share, share_error."""
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count(F.lit(1)).alias("n_used"))
    table = rates.join(used, "source", "left").fillna(0, ["tokens_used", "n_used"])
    total = used.agg(F.sum("tokens_used").alias("t")).first()["t"] or 0
    share = F.when(F.lit(total > 0), F.col("tokens_used") / F.lit(float(max(total, 1)))).otherwise(0.0)
    return table.withColumn("actual_share", share).withColumn("share_error", F.col("actual_share") - F.col("target_share"))
