"""Schedules of retries against a loop that sends one request after the other."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import retries

MINUTE, DAY = "RESOURCE_EXHAUSTED: requests per minute", "quota per day: exceeded your current quota"
KIND = "request_id string, model string, ord int, status int, retry_after string, body string"


def stated(header, body):
    raw = header if header is not None else ("12.5" if '"retryDelay": "12.5s"' in (body or "") else None)
    try:
        seconds = float(raw.strip().removesuffix("s")) if raw is not None else None
    except ValueError:
        return None
    return None if seconds is None or seconds < 0 else min(seconds, 75.0)


def loop(request, rows, max_retries, max_waits=6):
    """(outcome, attempts, waits, total wait, requests) of responses in their order."""
    attempt = limits = sent = 0
    total = 0.0

    def backoff(ord_):
        delay = min(0.5 * 2.0**attempt, 30.0)
        h = int(hashlib.md5(f"{request}:{ord_}".encode()).hexdigest()[:8], 16)
        return delay + 0.25 * delay * h / 2**32

    for _, _, ord_, status, header, body in rows:
        sent += 1
        last = attempt == max_retries
        low = (body or "").lower()
        flat = low.replace("_", "")
        passes = status == 429 and not any(m in flat for m in ("perday", "per day", "daily limit")) and any(m in flat for m in ("perminute", "per minute", "rpm"))
        if status is None:
            if last:
                return "timed_out", attempt + 1, limits, total, sent
            total += backoff(ord_)
            attempt += 1
        elif 200 <= status < 300:
            return "answered", attempt + 1, limits, total, sent
        elif status == 429 and not passes and "exceeded your current quota" in low:
            return "quota_exhausted", attempt + 1, limits, total, sent
        else:
            wait = stated(header, body)
            if passes and limits < max_waits:
                limits += 1
                total += backoff(ord_) if wait is None else wait
                continue
            if status not in (429, 500, 502, 503, 504) or last:
                return "refused", attempt + 1, limits, total, sent
            total += backoff(ord_) if wait is None else wait
            attempt += 1
    return "unfinished", None, limits, total, sent


def test_equals_the_loop(spark):
    draw = random.Random(4)
    models = {"a": 3, "b": 0, "c": 1}
    choices = [(200, None, "ok"), (429, None, MINUTE), (429, "7s", MINUTE), (429, "900", MINUTE), (429, None, DAY), (429, None, "slow down"), (503, None, '{"retryDelay": "12.5s"}'), (500, "-3", None), (502, "soon", "x"), (404, None, "gone"), (None, "5", "never used")]
    weights = [2, 8, 4, 2, 1, 4, 4, 3, 3, 1, 4]
    logs = {}
    for k in range(400):
        model = draw.choice([*models, "unknown"])
        logs[f"r{k}"] = [(f"r{k}", model, 10 * i, *c) for i, c in enumerate(draw.choices(choices, weights, k=draw.randint(1, 16)))]
    rows = [r for log in logs.values() for r in log]
    draw.shuffle(rows)
    caps = spark.createDataFrame(list(models.items()), "model string, max_retries int")
    scheduled = retries.schedule(spark.createDataFrame(rows, KIND).repartition(4), caps)
    got = {r.request_id: r for r in retries.outcomes(scheduled).collect()}
    seen = set()
    for name, log in logs.items():
        outcome, attempts, waits, total, sent = loop(name, log, models.get(log[0][1], 0))
        r = got[name]
        assert (r.outcome, r.waits, r.requests) == (outcome, waits, sent), (name, log)
        assert r.total_wait == pytest.approx(total, abs=1e-9) and (attempts is None or r.attempts == attempts)
        assert (r.error is None) == (outcome in ("answered", "unfinished"))
        seen.add(outcome)
    assert seen == set(retries.OUTCOMES)


def test_waits_have_a_budget_of_their_own(spark):
    caps = spark.createDataFrame([("m", 1)], "model string, max_retries int")
    rows = [("r", "m", i, 429, None, MINUTE) for i in range(20)]
    scheduled = retries.schedule(spark.createDataFrame(rows, KIND), caps).orderBy("ord").collect()
    assert [(r.waits, r.attempt) for r in scheduled] == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (6, 0), (6, 1)]
    assert [r.ends for r in scheduled] == [None] * 7 + ["refused"] and scheduled[-1].wait is None


def test_errors_tell_no_secrets(spark):
    caps = spark.createDataFrame([("m", 0)], "model string, max_retries int")
    rows = [("r", "m", 0, 400, None, "bad key k-123 " + "x" * 300), ("t", "m", 0, None, None, None), ("q", "m", 0, 429, None, DAY)]
    scheduled = retries.schedule(spark.createDataFrame(rows, KIND), caps)
    got = {r.request_id: r.error for r in retries.outcomes(scheduled, "https://h.example/v1?key=k-123", F.lit("k-123")).collect()}
    assert got["r"].startswith("m: returned 400 for https://h.example/v1: bad key [redacted] x") and "k-123" not in got["r"]
    assert got["t"] == "m: timed out after 1 attempts" and got["q"].startswith("m: daily quota is exhausted.")
    assert retries.outcomes(retries.schedule(spark.createDataFrame([], KIND), caps)).count() == 0
