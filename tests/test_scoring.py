"""Hand-derived literals."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import classify, compare, curate, scoring, usage

C, L, I, P = "code_change", "flaky_test", "infra_environment", "pipeline_config"
PAIRS = [(C, C), (C, C), (C, L), (C, P), (L, L), (L, L), (L, C), (I, C), (I, L), (I, P)]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(PAIRS)], "case_id int, truth_class string, predicted_class string")


def test_confusion_is_dense_and_in_order(results):
    rows = scoring.confusion(results).orderBy("truth_ord", "predicted_ord").collect()
    assert [r.n for r in rows] == [2, 1, 0, 1, 1, 2, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0]


def test_class_metrics(results):
    rows = {r.failure_class: (r.support, r.precision, r.recall, round(r.f1, 6)) for r in scoring.class_metrics(results).collect()}
    assert rows[C] == (4, 0.5, 0.5, 0.5)
    assert rows[L] == (3, 0.5, 2 / 3, 0.571429)
    assert rows[I] == (3, 0.0, 0.0, 0.0) and rows[P] == (0, 0.0, 0.0, 0.0)


def test_headline(spark, results):
    r = scoring.headline(results).first()
    assert (r.n_cases, r.coverage, r.accuracy) == (10, 1.0, 0.4)
    assert abs(r.macro_f1 - 15 / 56) < 1e-12 and abs(r.cost_weighted_error - 0.85) < 1e-12
    none = scoring.headline(results.withColumn("predicted_class", F.lit(None).cast("string"))).first()
    assert none.coverage == 0.0 and none.accuracy is None and none.macro_f1 is None


def test_related_to_diff(spark):
    rows = spark.createDataFrame([(True, True), (True, True), (True, False), (False, True), (False, False), (None, True)], "t boolean, p boolean")
    r = scoring.binary_metrics(rows, "t", "p").first()
    assert r.n == 5 and all(abs(x - 2 / 3) < 1e-12 for x in (r.precision, r.recall, r.f1))


def test_localization(spark):
    cases = spark.createDataFrame([(["src/a.py"], ["src/a.py", "x.py"]), (["src/b.py"], ["x.py", "y.py", ".\\src\\b.py"]), ([], ["x.py"]), (["src/c.py"], None)], "truth array<string>, ranked array<string>")
    r = scoring.localization(cases).first()
    assert (r.n_evaluated, r.hit_at_1, r.hit_at_5) == (2, 0.5, 1.0) and abs(r.mrr - 2 / 3) < 1e-12
    five = spark.createDataFrame([(["z"], ["a", "b", "c", "d", " ./z\t"]), (["z"], [])], "truth array<string>, ranked array<string>")
    r = scoring.localization(five).first()
    assert (r.n_evaluated, r.hit_at_1, r.hit_at_5, r.mrr) == (2, 0.0, 0.5, 0.1)


def test_funnel(spark):
    schema = "attempted boolean, level int, localized boolean"
    r = scoring.funnel(spark.createDataFrame([(True, k, True) for k in range(5)], schema)).first()
    assert (r.n_attempted, r.applies, r.lints, r.failing_test_passes, r.nothing_else_broke) == (5, 4, 3, 2, 1)
    r = scoring.funnel(spark.createDataFrame([(True, 4, True), (False, None, False)], schema)).first()
    assert (r.n_cases, r.n_attempted, r.n_skipped, r.clean_fix_rate) == (2, 1, 1, 1.0)
    r = scoring.funnel(spark.createDataFrame([(True, 3, True), (True, 0, False), (False, None, False), (False, None, None)], schema)).first()
    assert (r.fix_rate, r.apply_rate) == (0.5, 0.5)
    rows = scoring.funnel_rows(scoring.funnel(spark.createDataFrame([(False, None, None)], schema))).collect()
    assert [x.share for x in rows] == [0.0] * 5


def test_control(spark):
    rows = spark.createDataFrame([("a", 4, 1), ("b", None, None), ("c", 2, 0), ("d", 4, 4)], "case_id string, reference_level int, corrupted_level int")
    got = {r.case_id: (r.usable, r.reason) for r in scoring.control(rows).collect()}
    assert got == {"a": (True, ""), "b": (False, "no reference fix stored"), "c": (False, "reference fix only reached LINTS"), "d": (False, "the corrupted fix passed too, so the build proves nothing")}


CARD = "coverage double, macro_f1 double, accuracy double, cost_weighted_error double, hit_at_1 double"


def test_gate_at_and_past_tolerance(spark):
    base = spark.createDataFrame([(1.0, 0.8, 0.75, 0.5, 0.6)], CARD)
    at = spark.createDataFrame([(1.0, 0.5, 0.55, 0.9, 0.25)], CARD)
    past = spark.createDataFrame([(0.999, 0.499, 0.549, 0.901, 0.249)], CARD)
    better = spark.createDataFrame([(1.0, 0.9, 0.9, 0.1, 0.9)], CARD)
    flags = lambda c, **k: [r.regressed for r in compare.gate(base, c, **k).orderBy("ord").collect()]
    assert flags(at) == [False] * 5 and flags(past) == [True] * 5 and flags(better) == [False] * 5
    assert flags(at, both_baselines=True) == [False, True, True, True, True]
    lost = compare.gate(base, at.withColumn("hit_at_1", F.lit(None).cast("double")))
    assert [r.metric for r in lost.orderBy("ord").collect()] == ["coverage", "macro_f1", "accuracy", "cost_weighted_error"]


def test_problems_and_flips(spark):
    schema = "model string, subset string, dataset_hash string, macro_f1 double"
    a, b = spark.createDataFrame([("m", "all", "h", 0.5)], schema), spark.createDataFrame([("m", "smoke", "i", None)], schema)
    assert sorted(tuple(r) for r in compare.problems(a, b).collect()) == [("changed", "dataset changed: h to i"), ("changed", "subset changed: all to smoke"), ("lost", "classification")]
    assert [tuple(r) for r in compare.problems(a.withColumn("hit_at_1", F.lit(0.5)), a.withColumn("model", F.lit(None).cast("string"))).collect()] == [("changed", "model changed: m to none"), ("lost", "localization")]
    assert compare.problems(a.select("macro_f1"), a).count() == 0 and compare.problems(b.select("macro_f1").withColumnRenamed("macro_f1", "x"), a).count() == 0
    assert [r.line for r in compare.problem_lines(compare.problems(a, b)).orderBy("ord").collect()] == ["Reports lost since the baseline: classification", "Not comparable: subset changed: all to smoke; dataset changed: h to i"]
    was, now = ([(1, True), (2, False), (3, True)], [(1, False), (2, True), (4, False)])
    rows = compare.flips(spark.createDataFrame(was, "case_id int, correct boolean"), spark.createDataFrame(now, "case_id int, correct boolean")).collect()
    assert sorted(map(tuple, rows)) == [(1, "newly_failing"), (2, "newly_passing")]


def test_spreads(spark):
    rows = spark.createDataFrame([("m", 0.714), ("m", 0.450), ("m", 0.600), ("one", 0.3)], "model string, macro_f1 double")
    got = {r.model: r for r in compare.spreads(rows, ["model"], ["macro_f1"]).collect()}
    assert (got["m"].low, got["m"].high, round(got["m"].spread, 3), round(got["m"].mean, 3)) == (0.45, 0.714, 0.264, 0.588)
    assert got["one"].stdev == 0.0


def test_ranking_and_winners(spark):
    rows = [("a", 0, 1.0, 0.5, 1.0, 9.0, None), ("b", 1, 1.0, 0.5, 1.0, 3.0, None), ("c", 2, 0.9, 0.9, 0.1, 1.0, None), ("d", 3, None, None, None, None, "down")]
    models = spark.createDataFrame(rows, "model string, ordinal int, coverage double, macro_f1 double, cost double, seconds double, error string")
    assert [r.model for r in compare.ranked(models).orderBy("place").collect()] == ["a", "b", "c", "d"]
    w = compare.winners(models).first()
    assert (w.best_macro_f1, w.cheapest, w.fastest, w.n_complete) == ("a", "a", "b", 2)
    assert compare.winners(models.where("error IS NOT NULL")).first().best_macro_f1 is None


def test_majority(spark):
    rows = spark.createDataFrame([(1, L), (2, C), (3, C), (4, L)], "i int, truth_class string")
    assert tuple(classify.majority_class(rows, "i").first()) == (L, "async_wait")
    assert tuple(classify.majority_class(rows.limit(0), "i").first()) == (C, "test_assertion")


def test_python_classifier_isolates_errors(spark):
    def classify_one(log, diff):
        if log == "boom":
            raise KeyError("x")
        return {"failure_class": C, "subcategory": "type_check"}

    rows = classify.python_classifier(spark.createDataFrame([(1, "ok", None), (2, "boom", "d")], "id int, log string, diff string"), classify_one).orderBy("id").collect()
    assert rows[0].failure_class == C and rows[0].error is None
    assert rows[1].failure_class is None and rows[1].error.startswith("KeyError")


def test_gates(spark):
    rows = [(C, 0.9, ["a"]), (L, 0.9, ["a"]), (P, 0.59, ["a"]), (C, 0.6, []), (C, 0.6, None)]
    out = spark.createDataFrame(rows, "c string, k double, f array<string>").select(classify.skip_reason(F.col("c"), F.col("k"), F.col("f")).alias("r")).collect()
    assert [r.r is None for r in out] == [True, False, False, False, False]
    valid = spark.createDataFrame([(C, "type_check"), (L, "type_check"), ("x", "y"), (None, None)], "c string, s string").select(classify.valid_verdict(F.col("c"), F.col("s")).alias("v")).collect()
    assert [r.v for r in valid] == [True, False, False, False]


def test_selection_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        rows = [(f"t{i}", rng.choice("abc"), rng.choice([None, "p", "q", "r", "s", "t"]), i) for i in range(60)]
        old = [(f"t{rng.randint(0, 70)}", rng.choice("abc"), rng.choice(["p", "q"])) for _ in range(6)]
        tags, bugs = {o[0] for o in old}, {o[1:] for o in old}
        had = {r: sum(o[1] == r for o in old) for r in "abc"}
        want, seen = [], set()
        for tag, repo, bug, _ in rows:
            if bug is None or tag in tags or (repo, bug) in bugs or (repo, bug) in seen or had[repo] >= 4:
                continue
            seen.add((repo, bug))
            had[repo] += 1
            want.append(tag)
        got = curate.select_new(spark.createDataFrame(rows, "tag string, repo string, bug string, ordinal int"), spark.createDataFrame(old, "tag string, repo string, bug string"), cap=4, limit=5)
        assert [r.tag for r in got.orderBy("ordinal").collect()] == want[:5]


def test_hash_goes_by_content_only(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id int, v string")
    h = lambda r: curate.bucketed_hash(r.withColumn("d", curate.row_digest(F.col("id"), F.col("v"))), "id", "d").first()[0]
    assert h(rows) == h(rows.orderBy(F.desc("id")).repartition(7)) and len(h(rows)) == 12
    assert h(rows) != h(rows.withColumn("v", F.when(F.col("id") == 7, "w").otherwise(F.col("v"))))


def test_token_bucket(spark):
    reqs = spark.createDataFrame([("p", i, 0.0) for i in range(4)] + [("free", 9, 5.0)], "provider string, request_id long, at double")
    caps = spark.createDataFrame([("p", 2), ("free", None)], "provider string, rpm int")
    out = {r.request_id: r.waited for r in usage.token_bucket(reqs, caps).collect()}
    assert out == {0: 0.0, 1: 0.0, 2: 30.0, 3: 60.0, 9: 0.0}


def test_token_bucket_equals_a_loop_and_has_no_groups_in_python(spark):
    import random

    rng = random.Random(5)
    caps = {"a": 7, "b": 60, "c": 1, "free": None}
    reqs, ids = [], iter(range(10**6))
    for provider in (*caps, "unknown"):
        at = 1.7e9
        for _ in range(400):
            at += rng.choice([0, 0, 0.25, 1, 3, 30, 300])
            reqs.append((provider, next(ids), at))
    want = {}
    for provider in (*caps, "unknown"):
        rpm = caps.get(provider)
        level, now = rpm, None
        for _, i, at in sorted(r for r in reqs if r[0] == provider):
            start = at if rpm is None or now is None else max(at, now)
            if rpm is not None:
                level = level if now is None else min(rpm, level + (start - now) * rpm / 60)
                if level < 1:
                    start += (1 - level) * 60 / rpm
                    level = 1.0
                level, now = level - 1, start
            want[i] = start
    rng.shuffle(reqs)
    out = usage.token_bucket(spark.createDataFrame(reqs, "provider string, request_id long, at double"), spark.createDataFrame(list(caps.items()), "provider string, rpm int"))
    assert out.columns == ["provider", "request_id", "at", "admitted_at", "waited"]
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == len(reqs) and max(abs(got[i].admitted_at - w) for i, w in want.items()) < 1e-4
    assert all(abs(r.waited - (r.admitted_at - r.at)) < 1e-9 for r in got.values())
    assert "InPandas" not in out._jdf.queryExecution().toString()
