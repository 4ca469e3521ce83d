"""Rules between the fields of a row, held as data: one scan counts what breaks each and keeps a sample, or marks every row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from emberline import registry


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule if condition, a SQL expression, is false; where it is null, the rule says nothing about the row."""

    name: str
    condition: str
    message: str


def _one_of(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


#: Of case_results: a case that was dropped tells why, and can't be right.
RESULT_RULES = (
    Rule("verdict_or_error", "predicted_class IS NOT NULL OR coalesce(error, '') <> ''", "a case has no verdict and no error explaining why"),
    Rule("correct_needs_verdict", "predicted_class IS NOT NULL OR NOT coalesce(correct, false)", "a case cannot be correct without a verdict"),
    Rule("correct_is_equality", "correct = (predicted_class = truth_class)", "a case is correct if, and only if, its verdict is the truth"),
    Rule("known_truth", f"coalesce({_one_of('truth_class', registry.FAILURE_CLASSES)}, false)", "the true class is none of the taxonomy"),
    Rule("known_verdict", _one_of("predicted_class", registry.FAILURE_CLASSES), "the predicted class is none of the taxonomy"),
)

_ASKED, _AGREE = "coalesce(provenance.independent_adjudications, 0)", "coalesce(provenance.adjudicators_agreeing, 0)"
_PAIRS = " OR ".join(f"(ground_truth.failure_class = {c!r} AND {_one_of('ground_truth.subcategory', s)})" for c, s in registry.SUBCATEGORIES.items())
#: Of cases as sources.cases.load_cases() has them.
CASE_RULES = (
    Rule("agreement_is_possible", f"{_AGREE} <= {_ASKED}", "more adjudicators agree than were asked"),
    Rule("smoke_is_trusted", f"NOT coalesce(array_contains(tags, 'smoke'), false) OR coalesce(provenance.verified_by_human, false) OR ({_ASKED} >= 2 AND {_AGREE} = {_ASKED})", "a smoke case is not trusted"),
    Rule("method_has_command", "coalesce(verification.method, 'none') = 'none' OR verification.test_command IS NOT NULL", "a verification method without a test command"),
    Rule("subcategory_of_class", f"coalesce({_PAIRS}, false)", "a subcategory of another class"),
)


def broken(rule: Rule) -> Column:
    return F.coalesce(~F.expr(rule.condition), F.lit(False))


def _spot(key: str, samples: int) -> Column:
    """A number below samples for each key, by a hash of it."""
    return F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long") % samples


def _measures(rules: tuple[Rule, ...], key: str, samples: int) -> list[Column]:
    out = [F.count("*").alias("n_rows")]
    for i, rule in enumerate(rules):
        out.append(F.count_if(broken(rule)).alias(f"n_{i}"))
        out += [F.min(F.when(broken(rule) & (_spot(key, samples) == k), F.col(key).cast("string"))).alias(f"s_{i}_{k}") for k in range(samples)]
    return out


def evaluate(rows: DataFrame, rules: tuple[Rule, ...], key: str, samples: int = 5) -> DataFrame:
    """(rule, message, n_rows, n_broken, offenders) for each rule, by one aggregate over rows.

    offenders are up to `samples` keys as text, in order: of the keys that break the rule, parted into `samples` classes by a hash, the first
    of each class. So the sample is the same at every run, and no more than that is ever kept of a rule that all rows break.
    """
    found = rows.agg(*_measures(rules, key, samples))
    each = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"), F.col("n_rows"), F.col(f"n_{i}").alias("n_broken"), F.array_sort(F.array_compact(F.array(*[F.col(f"s_{i}_{k}") for k in range(samples)]))).alias("offenders"))
        for i, r in enumerate(rules)
    ]
    return found.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def watched(rows: DataFrame, rules: tuple[Rule, ...], key: str, samples: int = 5) -> tuple[DataFrame, Observation]:
    """rows as they are, and what will hold n_rows, n_ and s_ of each rule's number once an action has gone over all of them: the rules ride
    along with a scan that is made anyway. report() reads it."""
    seen = Observation()
    return rows.observe(seen, *_measures(rules, key, samples)), seen


def report(seen: Observation, rules: tuple[Rule, ...], samples: int = 5) -> dict[str, tuple[int, list[str]]]:
    """rule -> (how many rows broke it, offenders), after an action."""
    got = seen.get
    return {r.name: (got[f"n_{i}"], sorted(x for k in range(samples) if (x := got[f"s_{i}_{k}"]) is not None)) for i, r in enumerate(rules)}


def marked(rows: DataFrame, rules: tuple[Rule, ...], name: str = "violations") -> DataFrame:
    """rows with the names of the rules that each breaks, as an array in the order of rules."""
    return rows.withColumn(name, F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])))


def enforced(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows; a job over them fails with a rule's message at the first row that breaks it."""
    for r in rules:
        rows = rows.where(F.assert_true(~broken(r), F.lit(f"{r.name}: {r.message}")).isNull())
    return rows
