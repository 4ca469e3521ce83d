"""Retries of model requests: what each response of a log leads to, how long is waited, and how requests end.

Two budgets are kept apart. A refusal that passes by itself is waited for, max_waits times at most, and costs no attempt; other failures that may
pass cost one of max_retries + 1 attempts. A spent allowance ends a request at once. All of it is running counts over a
request's responses, so nothing but windows is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import redact_url, server_wait_seconds
from emberline.operators.classify import quota_exhausted, rate_limited
from emberline.operators.usage import backoff_seconds

OUTCOMES = ("answered", "quota_exhausted", "timed_out", "refused", "unfinished")


def kind(status: Column, body: Column) -> Column:
    """What a response is: success, quota, rate (a limit that passes), timeout (no status), retryable or final."""
    return (
        F.when(status.isNull(), "timeout")
        .when(status.between(200, 299), "success")
        .when(quota_exhausted(status, body), "quota")
        .when(rate_limited(status, body), "rate")
        .when(status.isin(registry.RETRYABLE_STATUSES), "retryable")
        .otherwise("final")
    )


def jitter(request: Column, ord_: Column, seconds: Column) -> Column:
    """Up to a quarter of seconds, by a hash of the request and the response's place: spread out, but the same at every run."""
    h = F.conv(F.left(F.md5(F.concat_ws(":", request.cast("string"), ord_.cast("string"))), F.lit(8)), 16, 10).cast("double")
    return seconds * F.lit(registry.JITTER_FRACTION) * (h / F.lit(4294967296.0))


def schedule(responses: DataFrame, caps: DataFrame, max_waits: int = registry.MAX_RATE_LIMIT_WAITS) -> DataFrame:
    """responses(request_id, model, ord, status, retry_after, body) that were asked for, with kind, attempt, waits, wait and ends.

    caps(model, max_retries): an unknown model has no retries. Responses of a request go in the order of ord. attempt counts from 0 the attempts that were spent
    before; waits the refusals that were waited for, this one included; wait is the seconds until the next request, null where
    none follows; ends says how the request ends with this response, null where it goes on. Responses after an end are not returned: they were never asked for.
    """
    order = Window.partitionBy("request_id").orderBy("ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each model.
    rows = responses.join(F.broadcast(caps.select("model", "max_retries")), "model", "left").withColumn("max_retries", F.coalesce("max_retries", F.lit(0)))
    rows = rows.withColumn("kind", kind(F.col("status"), F.col("body")))
    limits = F.count_if(F.col("kind") == "rate").over(so_far)
    waited = (F.col("kind") == "rate") & (limits <= max_waits)
    rows = rows.withColumn("waited", waited).withColumn("waits", F.least(limits, F.lit(max_waits)).cast("int"))
    costs = ~F.col("waited") & F.col("kind").isin("timeout", "rate", "retryable")
    rows = rows.withColumn("costs", costs).withColumn("attempt", F.coalesce(F.count_if("costs").over(before), F.lit(0)).cast("int"))
    last = F.col("attempt") >= F.col("max_retries")
    ends = (
        F.when(F.col("kind") == "success", "answered")
        .when(F.col("kind") == "quota", "quota_exhausted")
        .when((F.col("kind") == "timeout") & last, "timed_out")
        .when((F.col("kind") == "final") | (F.col("costs") & last), "refused")
    )
    rows = rows.withColumn("ends", ends)
    asked = rows.withColumn("ended", F.coalesce(F.count("ends").over(before), F.lit(0))).where("ended = 0")
    pause = backoff_seconds(F.col("attempt"), registry.MAX_BACKOFF_SECONDS)
    pause = pause + jitter(F.col("request_id"), F.col("ord"), pause)
    stated = F.when(F.col("status").isNotNull(), server_wait_seconds(F.col("retry_after"), F.col("body")))
    wait = F.when(F.col("ends").isNull(), F.coalesce(stated, pause))
    return asked.withColumn("wait", wait).drop("waited", "costs", "ended")


def outcomes(scheduled: DataFrame, url: str | None = None, secret: Column | None = None) -> DataFrame:
    """(request_id, model, outcome, attempts, waits, total_wait, requests, error) of what schedule() returned, one row a request.

    attempts are those that counted, the last one included; requests are all that were sent. outcome is unfinished if the log stops before an end. error says
    why there is no answer: the beginning of the body, without what follows ? or # in url and without secret; null for answers.
    """
    ended = F.max_by("ends", "ord")
    spent = F.max_by("attempt", "ord") + F.when(F.max_by(F.col("kind"), "ord") == "rate", F.when(ended.isNull(), 0).otherwise(1)).otherwise(1)
    sums = scheduled.groupBy("request_id", "model").agg(
        F.coalesce(ended, F.lit("unfinished")).alias("outcome"),
        spent.cast("int").alias("attempts"),
        F.max_by("waits", "ord").alias("waits"),
        F.sum(F.coalesce("wait", F.lit(0.0))).alias("total_wait"),
        F.count("*").alias("requests"),
        F.max_by("status", "ord").alias("status"),
        F.max_by("body", "ord").alias("body"),
        F.max("max_retries").alias("max_retries"),
    )
    shown = F.left(F.coalesce("body", F.lit("")), F.lit(registry.PREVIEW_CHARS))
    if secret is not None:
        shown = F.when(F.coalesce(secret, F.lit("")) != "", F.replace(shown, secret, F.lit(registry.REDACTED))).otherwise(shown)
    place = F.lit("") if url is None else F.concat(F.lit(" for "), redact_url(F.lit(url)))
    error = (
        F.when(F.col("outcome") == "quota_exhausted", F.concat("model", F.lit(": daily quota is exhausted. Wait for it to reset or pick another model.")))
        .when(F.col("outcome") == "timed_out", F.concat("model", F.lit(": timed out after "), (F.col("max_retries") + 1).cast("string"), F.lit(" attempts")))
        .when(F.col("outcome") == "refused", F.concat(F.col("model"), F.lit(": returned "), F.col("status").cast("string"), place, F.lit(": "), shown))
    )
    return sums.select("request_id", "model", "outcome", "attempts", "waits", "total_wait", "requests", error.alias("error"))
