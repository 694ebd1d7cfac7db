"""Token counts from an exact histogram of document lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_histogram(lengths: DataFrame, n_tokens: str = "n_tokens", by: list[str] | None = None) -> DataFrame:
    """Documents per length (and group): `(by..., n_tokens, n_docs)`. Null lengths count as 0.

    Counts are added up in each task before the shuffle, so a length or group that a third of all documents share is no hot
    key. There are no more rows than distinct lengths, at most the length of the longest document, in each group.
    """
    return lengths.groupBy(*(by or []), F.coalesce(F.col(n_tokens), F.lit(0)).cast("bigint").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For every length L that occurs, taken as a context limit: exact counts of what fits and what is cut.

    `docs_up_to`, `tokens_up_to`: documents of at most L tokens; `docs_longer`, `tokens_longer`: the others (the suffix sums);
    `tokens_truncated`: tokens left when every document is cut at L; `tokens_cut`: tokens lost; `doc_share`, `token_share`:
    share of documents and tokens at or below L, so the p-quantile is the smallest L with `doc_share >= p`. A limit between two
    lengths is answered from the next smaller row (`at_limit`). No documents give no rows.
    """
    keys = by or []
    upto = Window.partitionBy(*keys).orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    zero = F.lit(0).cast("bigint")
    sums = histogram.select(
        *keys,
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(upto).alias("docs_up_to"),
        F.sum(tokens).over(upto).alias("tokens_up_to"),
        F.coalesce(F.sum("n_docs").over(after), zero).alias("docs_longer"),
        F.coalesce(F.sum(tokens).over(after), zero).alias("tokens_longer"),
    )
    truncated = F.col("tokens_up_to") + F.col("docs_longer") * F.col("n_tokens")
    total = F.col("tokens_up_to") + F.col("tokens_longer")
    return sums.select(
        "*",
        truncated.alias("tokens_truncated"),
        (total - truncated).alias("tokens_cut"),
        (F.col("docs_up_to") / (F.col("docs_up_to") + F.col("docs_longer"))).alias("doc_share"),
        F.coalesce(F.try_divide("tokens_up_to", total), F.lit(1.0)).alias("token_share"),
    )


def at_limit(totals: DataFrame, limits: list[int], by: list[str] | None = None) -> DataFrame:
    """Tokens left and documents cut for the given context limits: `(by..., context, tokens_truncated, docs_cut)`.

    A limit below the shortest length cuts every document. `limits` is a short list of the caller.
    """
    asked = [F.struct(F.lit(int(n)).alias("context")) for n in limits]
    rows = totals.select("*", F.explode(F.array(*asked)).alias("_l")).withColumn("context", F.col("_l.context"))
    fits = F.col("n_tokens") <= F.col("context")
    tokens = F.col("n_tokens") * F.col("n_docs")
    return rows.groupBy(*(by or []), "context").agg(
        F.sum(F.when(fits, tokens).otherwise(F.col("context") * F.col("n_docs"))).alias("tokens_truncated"),
        F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).cast("bigint").alias("docs_cut"),
    )


def quantiles(totals: DataFrame, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles: for each share p the smallest length that at least the share p of the documents does not pass."""
    asked = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    rows = totals.select("*", asked).filter(F.col("doc_share") >= F.col("share"))
    return rows.groupBy(*(by or []), "share").agg(F.min("n_tokens").alias("n_tokens"))
