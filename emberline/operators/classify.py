"""Classifiers and gates. A classifier is a function from cases to predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import first_rule, is_setup_step


def regex_classifier(cases: DataFrame, log: str = "log", has_diff: str | None = None) -> DataFrame:
    """cases with failure_class, subcategory, related_to_diff, confidence by the first rule found in the whole log.

    Related to the diff: there is one, and the class is code_change or pipeline_config. A null log matches no rule.
    """
    rule = first_rule(F.coalesce(F.col(log), F.lit("")))
    out = cases.withColumn("verdict", rule).withColumn("failure_class", F.col("verdict.failure_class")).withColumn("subcategory", F.col("verdict.subcategory"))
    diff = F.col(has_diff) if has_diff else F.lit(False)
    return out.withColumn("related_to_diff", F.coalesce(diff, F.lit(False)) & F.col("failure_class").isin("code_change", "pipeline_config")).withColumn("confidence", F.lit(1.0)).drop("verdict")


def majority_class(labels: DataFrame, ordinal: str, label: str = "truth_class") -> DataFrame:
    """One row: failure_class, the most frequent label, of equally frequent ones that met first; subcategory.

    Without labels code_change; the subcategory is test_assertion where the class has it, else its first by name.
    """
    counts = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("failure_class")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    best = counts.agg(F.coalesce(F.max_by("failure_class", F.struct("n", -F.col("first"))), F.lit(registry.FALLBACK[0])).alias("failure_class"))
    sub = F.lit(registry.FALLBACK[1])
    for name, subs in registry.SUBCATEGORIES.items():
        sub = F.when(F.col("failure_class") == name, F.lit(registry.FALLBACK[1] if registry.FALLBACK[1] in subs else min(subs))).otherwise(sub)
    return best.select("failure_class", sub.alias("subcategory"))


def python_classifier(cases: DataFrame, classify: Callable[[str | None, str | None], dict], log: str = "log", diff: str = "diff") -> DataFrame:
    """cases with a Python function's verdicts; an exception becomes its row's error, never a failed job."""
    kept = [c for c in cases.columns if c not in (log, diff)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, patch in zip(frame[log], frame[diff], strict=True):
                try:
                    v = classify(text, patch)
                    rows.append((v["failure_class"], v["subcategory"], v.get("related_to_diff"), v.get("confidence", 1.0), None))
                except Exception as e:
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            verdicts = pd.DataFrame(rows, columns=["failure_class", "subcategory", "related_to_diff", "confidence", "error"], index=frame.index)
            yield pd.concat([frame[kept], verdicts], axis=1)

    ddl = ", ".join(f"`{c}` {cases.schema[c].dataType.simpleString()}" for c in kept)
    return cases.select(*kept, log, diff).mapInPandas(run, f"{ddl}, failure_class string, subcategory string, related_to_diff boolean, confidence double, error string")


def valid_verdict(failure_class: Column, subcategory: Column) -> Column:
    """Whether a class has a subcategory; false for unknown classes and nulls."""
    pairs = F.create_map(*[x for c, subs in registry.SUBCATEGORIES.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in subs]))])
    return F.coalesce(F.array_contains(F.try_element_at(pairs, failure_class), subcategory), F.lit(False))


def locatable(failure_class: Column) -> Column:
    return ~failure_class.isin("flaky_test", "infra_environment")


def skip_reason(failure_class: Column, confidence: Column, culprits: Column) -> Column:
    """Why no fix is attempted; null if one is. Class first, then confidence, then culprits."""
    return (
        F.when(~failure_class.isin("code_change", "pipeline_config"), F.concat(failure_class, F.lit(" failures have no repository file to patch. Rerun, pin, or quarantine instead.")))
        .when(confidence < registry.MIN_CONFIDENCE, F.concat(F.lit("classifier confidence "), F.format_string("%.2f", confidence), F.lit(f" is below {registry.MIN_CONFIDENCE:.2f}, so a patch would be built on a guess about the cause")))
        .when(F.coalesce(F.size(culprits), F.lit(0)) <= 0, F.lit("no culprit file was identified, so there is nothing to edit"))
    )


def signal(conclusion: Column, attempt: Column, rerun_passed: Column, failed_steps: Column) -> Column:
    """What a run's shape says, in this order: a rerun passed, cancelled or timed out, no failed step, a setup step failed."""
    first = F.get(failed_steps, F.lit(0))
    names = [F.lit(s) for s in registry.SIGNALS]
    return F.when(rerun_passed & (attempt > 1), names[0]).when(conclusion.isin("cancelled", "timed_out"), names[1]).when(F.coalesce(F.size(failed_steps), F.lit(0)) <= 0, names[2]).when(is_setup_step(first), names[3]).otherwise(names[4])


def _mentions(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def rate_limited(status: Column, body: Column) -> Column:
    """A 429 that passes by itself: the body speaks of a limit a minute, and of none a day."""
    flat = F.replace(F.lower(F.coalesce(body, F.lit(""))), F.lit("_"), F.lit(""))
    return F.coalesce((status == 429) & ~_mentions(flat, registry.PER_DAY) & _mentions(flat, registry.PER_MINUTE), F.lit(False))


def quota_exhausted(status: Column, body: Column) -> Column:
    """A 429 that won't pass until the allowance is renewed."""
    return F.coalesce((status == 429) & ~rate_limited(status, body) & _mentions(F.lower(F.coalesce(body, F.lit(""))), registry.QUOTA_EXHAUSTED), F.lit(False))


def violations(cases: DataFrame) -> DataFrame:
    """(case_id, violation): rows of cases that break a rule between fields."""
    p, v = F.col("provenance"), F.col("verification")
    n, agree = F.coalesce(p["independent_adjudications"], F.lit(0)), F.coalesce(p["adjudicators_agreeing"], F.lit(0))
    trusted = F.coalesce(p["verified_by_human"], F.lit(False)) | ((n >= 2) & (agree == n))
    checks = [
        F.when(agree > n, "more adjudicators agree than were asked"),
        F.when(F.array_contains("tags", "smoke") & ~trusted, "a smoke case is not trusted"),
        F.when((v["method"] != "none") & v["test_command"].isNull(), "a verification method without a test command"),
        F.when(~valid_verdict(F.col("ground_truth.failure_class"), F.col("ground_truth.subcategory")), "a subcategory of another class"),
    ]
    return cases.select("case_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
