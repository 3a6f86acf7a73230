"""Token counts by an exact length histogram.

Documents are encoded whole, then aggregated by encoded length: one row per distinct length, which
partial aggregation shrinks before the shuffle. Suffix sums over the lengths then answer, for every
context limit L: how many documents have at least L tokens, how many tokens they hold, and how many
tokens remain when every document is cut to L, namely (tokens of documents up to L) + L x (documents
longer than L). Quantiles are the first length whose cumulative count reaches the wanted share.

The suffix sums are taken in blocks of BLOCK lengths: within blocks in parallel, and over the block
totals (longest length / BLOCK rows) once.

Cases: a null or empty text has length 0; repeated rows count as often as they occur; texts of any length are encoded
whole; an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import checkpointed

BLOCK = 1024


def histogram(counted: DataFrame, column: str = "n_tokens") -> DataFrame:
    """length, n_docs of a column of lengths."""
    return counted.groupBy(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length that occurs: its documents and tokens, those of at least that length, and the
    total after truncation to it."""
    lengths = checkpointed(lengths)  # a row per length; else every branch below would encode the corpus again
    rows = lengths.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(blocks, "block")
    docs_from, tokens_from = F.sum("n_docs").over(inside) + F.col("later_docs"), F.sum("n_tokens").over(inside) + F.col("later_tokens")
    return rows.select(
        "length", "n_docs", "n_tokens", docs_from.alias("docs_at_least"), tokens_from.alias("tokens_at_least"), "all_docs", "all_tokens"
    ).select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that so large a share of the documents does not exceed."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return sums.select("length", "share_up_to", wanted).where("share_up_to >= share").groupBy("share").agg(F.min("length").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that remain of the whole corpus when documents are cut to any limit, from the suffix sums of
    the least longer length: all tokens without those of longer documents, and `limit` for each of these."""
    longer = F.when(F.col("length") > limit, F.struct("tokens_at_least", "docs_at_least"))
    found = sums.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("all"), F.min_by(longer, F.when(F.col("length") > limit, F.col("length"))).alias("x"))
    return found.select((F.col("all") + F.coalesce(F.col("x.docs_at_least") * F.lit(limit) - F.col("x.tokens_at_least"), F.lit(0))).alias("truncated_total"))
