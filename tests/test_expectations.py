import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import expectations as ex
from emberline.operators import run_totals
from emberline.sources.cases import CASE

RESULT = "case_id long, truth_class string, predicted_class string, correct boolean, error string"


def results(spark, n=300):
    draw = random.Random(6)
    rows = [(i, draw.choice(["code_change", "flaky_test", "bug", None]), draw.choice(["code_change", "flaky_test", "bug", None]), draw.choice([True, False, None]), draw.choice([None, "", "late"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, RESULT)


def plain(row):
    i, truth, told, correct, error = row
    known = ("code_change", "flaky_test", "infra_environment", "pipeline_config")
    return {
        "verdict_or_error": told is None and not error,
        "correct_needs_verdict": told is None and bool(correct),
        "correct_is_equality": None not in (correct, told, truth) and correct != (told == truth),
        "known_truth": truth not in known,
        "known_verdict": told is not None and told not in known,
    }


def test_one_scan_counts_and_samples(spark):
    rows, frame = results(spark)
    got = {r.rule: r for r in ex.evaluate(frame, ex.RESULT_RULES, "case_id", samples=7).collect()}
    for rule in ex.RESULT_RULES:
        bad = {str(r[0]) for r in rows if plain(r)[rule.name]}
        assert got[rule.name].n_broken == len(bad) > 0 and got[rule.name].n_rows == len(rows)
        assert set(got[rule.name].offenders) <= bad and 0 < len(got[rule.name].offenders) <= 7
        assert got[rule.name].offenders == sorted(got[rule.name].offenders)


def test_marks_and_watching_agree(spark):
    rows, frame = results(spark)
    marks = {r.case_id: r.violations for r in ex.marked(frame, ex.RESULT_RULES).collect()}
    assert marks == {r[0]: [n for n, b in plain(r).items() if b] for r in rows}
    seen_rows, seen = ex.watched(frame, ex.RESULT_RULES, "case_id")
    assert seen_rows.count() == len(rows)
    told = {r.rule: (r.n_broken, r.offenders) for r in ex.evaluate(frame, ex.RESULT_RULES, "case_id").collect()}
    assert ex.report(seen, ex.RESULT_RULES) == told


def test_no_rows_and_no_offenders(spark):
    empty = spark.createDataFrame([], RESULT)
    assert {(r.n_rows, r.n_broken, tuple(r.offenders)) for r in ex.evaluate(empty, ex.RESULT_RULES, "case_id").collect()} == {(0, 0, ())}
    good = spark.createDataFrame([(1, "code_change", None, False, "timed out")], RESULT)
    assert ex.enforced(good, ex.RESULT_RULES).count() == 1
    with pytest.raises(Exception, match="no verdict and no error"):
        ex.enforced(results(spark)[1].where("truth_class = 'code_change' AND predicted_class IS NULL"), ex.RESULT_RULES[:1]).collect()


def test_rules_of_cases(spark):
    case = lambda i, tags, asked, agree, human, method, command, sub: (i, {"failure_class": "flaky_test", "subcategory": sub}, {"verified_by_human": human, "independent_adjudications": asked, "adjudicators_agreeing": agree}, {"method": method, "test_command": command}, tags)
    rows = [case("a", ["smoke"], 2, 2, False, "none", None, "randomness"), case("b", ["smoke"], 2, 1, None, None, None, "randomness"), case("c", None, 1, 2, True, "docker", None, "yaml_syntax"), case("d", ["smoke"], None, None, True, "docker", "make", None)]
    kind = "case_id string, ground_truth struct<failure_class:string,subcategory:string>, provenance struct<verified_by_human:boolean,independent_adjudications:int,adjudicators_agreeing:int>, verification struct<method:string,test_command:string>, tags array<string>"
    marks = {r.case_id: r.violations for r in ex.marked(spark.createDataFrame(rows, kind), ex.CASE_RULES).collect()}
    assert marks == {"a": [], "b": ["smoke_is_trusted"], "c": ["agreement_is_possible", "method_has_command", "subcategory_of_class"], "d": ["subcategory_of_class"]}
    assert spark.createDataFrame([], CASE).select(*[F.expr(r.condition) for r in ex.CASE_RULES]).count() == 0


def test_run_totals_come_with_the_scan(spark):
    rows = [(f"m{i % 3}", i, 2 * i, i % 4 == 0, i % 5 == 0 if i % 2 else None, 1.5) for i in range(50)] + [("m0", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "model string, input_tokens long, output_tokens long, repaired boolean, failed boolean, latency_ms double")
    seen_rows, seen = run_totals.observed(frame)
    report = run_totals.with_totals(seen_rows.groupBy("model").agg(F.count("*").alias("n")), seen).collect()
    want = (51, sum(range(50)), 2 * sum(range(50)), 13, 5, 75.0, 5 / 51)
    assert {r.model: r.n for r in report} == {"m0": 18, "m1": 17, "m2": 16}
    assert {tuple(r)[2:] for r in report} == {want}
    nothing, seen = run_totals.observed(frame.where(F.lit(False)))
    nothing.count()
    assert run_totals.totals(seen)["schema_failure_rate"] == 0.0
