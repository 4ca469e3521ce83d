"""Totals of a scoring run, taken by the scan that scores it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: What is asked of a run's cases, one row a case: columns input_tokens, output_tokens, repaired, failed, latency_ms.
FIELDS = ("total_requests", "total_input_tokens", "total_output_tokens", "repairs", "schema_failures", "latency_ms")


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """results as they are, and an observation of their totals, which is there once an action has gone over all of them.

    results(input_tokens, output_tokens, repaired, failed, latency_ms, ...), one row a case; nulls count as zero or false.
    """
    seen = Observation()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    measures = (
        F.count("*").alias("total_requests"),
        zero("input_tokens").cast("long").alias("total_input_tokens"),
        zero("output_tokens").cast("long").alias("total_output_tokens"),
        F.count_if(F.coalesce("repaired", F.lit(False))).alias("repairs"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("schema_failures"),
        zero("latency_ms").cast("double").alias("latency_ms"),
    )
    return results.observe(seen, *measures), seen


def totals(seen: Observation) -> dict[str, int | float]:
    """The totals after an action, with schema_failure_rate: the share of cases without a valid answer, 0 of none."""
    got = dict(seen.get)
    n = got["total_requests"]
    return got | {"schema_failure_rate": got["schema_failures"] / n if n else 0.0}


def with_totals(reduced: DataFrame, seen: Observation) -> DataFrame:
    """The rows of a small report, and beside each the totals of the scan that made it: reduced is run, once, to learn them.

    reduced: an aggregate of observed() results with few rows, such as one a model, which go through the driver.
    """
    rows = reduced.toArrow()
    frame = reduced.sparkSession.createDataFrame(rows, reduced.schema)
    return frame.withColumns({k: F.lit(v).cast("long" if isinstance(v, int) else "double") for k, v in totals(seen).items()})
