"""Tokens, prices and quotas: cost by model, daily use, whether a run fits, and the token bucket of a provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import registry


def model_dim(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.provider, m.rpm, m.rpd, m.tpd, m.list_in, m.list_out) for m in registry.MODELS]
    return spark.createDataFrame(rows, "model string, provider string, rpm int, rpd int, tpd int, list_in double, list_out double")


def costs(usage: DataFrame) -> DataFrame:
    """(model, n_requests, input_tokens, output_tokens, list_price_usd, per_request_usd) of usage(model, input_tokens, output_tokens).

    An unknown model has tokens, but no price. Baseline models use none and are left out.
    """
    sums = usage.where(~F.coalesce(F.col("model").isin(registry.BASELINE_MODELS), F.lit(False))).groupBy("model").agg(F.count("*").alias("n_requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    dim = F.broadcast(model_dim(usage.sparkSession).select("model", "list_in", "list_out"))
    price = (F.col("input_tokens") * F.col("list_in") + F.col("output_tokens") * F.col("list_out")) / 1e6
    return sums.join(dim, "model", "left").select("model", "n_requests", "input_tokens", "output_tokens", price.alias("list_price_usd"), F.try_divide(price, F.col("n_requests")).alias("per_request_usd"))


def daily(usage: DataFrame) -> DataFrame:
    """(provider, day, requests, tokens)"""
    return usage.groupBy("provider", "day").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def preflight(used: DataFrame, caps: DataFrame, needed: int) -> DataFrame:
    """(provider, day, remaining, refusal) of used(provider, day, requests, tokens) against caps(provider, rpd, tpd).

    A null cap is none. Tokens are looked at first: a day's tokens spent refuses, then too few requests left.
    """
    remaining = F.when(F.col("rpd").isNotNull(), F.greatest(F.lit(0), F.col("rpd") - F.col("requests")))
    refusal = F.when(F.col("tpd").isNotNull() & (F.col("tokens") >= F.col("tpd")), "tokens_spent").when(remaining < needed, "too_few_requests")
    return used.join(F.broadcast(caps), "provider", "left").select("provider", "day", remaining.alias("remaining"), refusal.alias("refusal"))


def output_token_budget(model: Column) -> Column:
    """Tokens that a model may answer with: more for those that reason first. Null for an unknown model."""
    out = F.lit(None).cast("int")
    for m in registry.MODELS:
        out = F.when(model == m.name, registry.REASONING_OUTPUT_TOKENS if m.reasoning else registry.DIRECT_OUTPUT_TOKENS).otherwise(out)
    return out


def backoff_seconds(attempt, cap: float = 30.0):
    """Seconds before jitter after so many failed attempts."""
    return F.least(F.lit(0.5) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def token_bucket(requests: DataFrame, caps: DataFrame) -> DataFrame:
    """requests(provider, request_id, at seconds) with admitted_at and waited, by a bucket of rpm tokens refilled rpm / 60 a second.

    A null rpm admits at once. Requests go in the order of at, then id. Request n of a provider, from 0, is admitted at the latest of at
    and, for each m up to n, at of m and the time that n - m + 1 tokens take beyond a full bucket: a running maximum over ranks. Both
    are taken within ranges of time, which are set off by the ranges before, so no task has a whole large provider.
    """
    spark = requests.sparkSession
    rows = requests.join(F.broadcast(caps), "provider", "left").select("provider", "request_id", "at", "rpm")
    free = rows.where("rpm IS NULL").select("provider", "request_id", "at", F.col("at").alias("admitted_at"))
    capped = rows.where("rpm IS NOT NULL")
    # Cuts reach the driver, so that every use has the same: a row for each provider with a cap.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = capped.groupBy("provider").agg(F.min("at").alias("base"), F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], 10000).alias("cuts"))
    cuts = spark.createDataFrame([tuple(r) for r in cuts.collect()], "provider string, base double, cuts array<double>")
    last = F.lit(n + 1)  # a null time comes after all others
    part = F.when(F.col("at").isNull(), last).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("at"))))
    order = Window.partitionBy("provider", "part").orderBy(F.asc_nulls_last("at"), "request_id")
    each = F.lit(60.0) / F.col("rpm")
    ranked = capped.join(F.broadcast(cuts), "provider").withColumn("part", part).withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("early", F.col("at") - F.col("base") - F.col("i") * each)
    parts = ranked.groupBy("provider", "part", "rpm").agg(F.count("*").alias("k"), F.max("early").alias("most"))
    before = Window.partitionBy("provider").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("most", F.col("most") - F.col("first") * each)
    parts = parts.select("provider", "part", "first", F.max("most").over(before).alias("so_far"))
    placed = ranked.join(F.broadcast(parts), ["provider", "part"])
    own = F.max("early").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("first") * each
    rank = F.col("first") + F.col("i")
    admitted = F.greatest("at", F.col("base") + F.greatest(own, "so_far") + (rank + 1 - F.col("rpm")) * each)
    placed = placed.select("provider", "request_id", "at", F.when(F.col("at").isNotNull(), admitted).alias("admitted_at"))
    return free.unionByName(placed).withColumn("waited", F.col("admitted_at") - F.col("at"))
