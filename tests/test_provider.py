import json

import pytest
from pyspark.sql import functions as F

from emberline.functions import provider as pv
from emberline.functions import text as tx
from emberline.operators import classify


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first().r


def test_jobs(spark):
    raw = json.dumps({"id": 31063661240, "name": "tests", "conclusion": "weird", "steps": [{"number": 1, "name": "Set up", "conclusion": "success"}, {"number": 2, "name": "Run", "conclusion": "failure"}]})
    j = one(spark, raw, pv.job)
    assert (j.job_id, j.conclusion, j.steps[1].conclusion) == (31063661240, None, "failure")
    assert [s.number for s in one(spark, raw, lambda c: pv.failed_steps(pv.job(c)["steps"]))] == [2]
    assert one(spark, json.dumps({"id": 1, "name": "x"}), pv.job).steps == []
    pulls = spark.createDataFrame([("s", 1, 10, "closed"), ("s", 2, 11, "open"), ("t", 1, 12, "closed"), ("t", 2, 13, "closed")], "sha string, ordinal int, number int, state string")
    assert {r.sha: r.number for r in pv.pull_of_commit(pulls).collect()} == {"s": 11, "t": 12}


def test_archive_names(spark):
    long = "j" * 85
    names = F.array(F.lit("a b"), F.lit(long), F.lit("j" * 80), F.lit("j"))
    assert one(spark, "a/b", lambda c: pv.best_match(names, pv.archive_name(c))) == "a b"
    assert one(spark, long + "more", lambda c: pv.best_match(names, c)) == long
    assert one(spark, "jj", lambda c: pv.best_match(names, c)) is None


def test_container_results(spark):
    ok = "x\nhunk 1 ok\n##APPLIED## 2\nbuild"
    r = one(spark, ok, lambda c: pv.apply_result(F.lit(0), c, "##APPLIED##"))
    assert tuple(r) == (True, True, True, "x\nhunk 1 ok")
    level = lambda text, rc: one(spark, text, lambda c: pv.verification(pv.apply_result(F.lit(rc), c, "##APPLIED##"), c))
    assert tuple(level(ok, 0))[:2] == (4, "the original job passes with the patch applied after repairing its hunk headers")
    assert tuple(level(ok.replace("2", "0"), 1))[:2] == (1, "patch applies but the build still fails")
    assert tuple(level("error: corrupt\n##APPLIED## 1\nmore", 0)) == (0, "patch does not apply", "error: corrupt")
    assert level("nothing", 0).level == 0
    assert tuple(one(spark, "root=/r project=p log=/x root", pv.layout)) == ("/r", "p") and tuple(one(spark, "none", pv.layout)) == ("", "")
    diff = "diff -r /r/failed/p/a.py /r/passed/p/a.py\n--- /r/failed/p/a.py\t2020\n+++ /r/passed/p/a.py\t2020\r\n-/r/failed/p/x\n+y\r\n"
    assert one(spark, diff, lambda c: pv.normalized_diff_paths(c, F.lit("/r"), F.lit("p"))) == "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n-/r/failed/p/x\n+y\r\n"
    assert one(spark, diff, lambda c: pv.normalized_diff_paths(c, F.lit(""), F.lit("p"))) == diff


def test_prompts(spark):
    raw = "---\r\nid: triage\r\n# note\nversion: 'v2'\n---\nHello {name} \n"
    p = one(spark, raw, pv.prompt)
    assert p.meta == {"id": "triage", "version": "v2"} and p.body == "Hello {name}"
    assert one(spark, "Hello {name}\r\n", pv.content_hash) == p.content_hash
    assert one(spark, "no fence", pv.prompt) is None and one(spark, "---\nversion: 1\n---\nx", pv.prompt) is None
    assert one(spark, "Hello {name}", lambda c: pv.rendered_prompt(c, {"name": F.lit("you")})) == "Hello you"
    assert one(spark, "{a}{b} {{a}} {{{a}}}", lambda c: pv.rendered_prompt(c, {"a": F.lit("{b}"), "b": F.lit("}{"), "unused": F.lit(None)})) == "{b}}{ {a} {{b}}"
    assert one(spark, "x {a}", lambda c: pv.rendered_prompt(c, {"a": F.lit(None).cast("string")})) is None and one(spark, "", lambda c: pv.rendered_prompt(c, {})) == ""
    for bad, why in (("{a} {c} {b}", "needs a value for c, b"), ("{a", "a brace stands alone"), ("a } b", "a brace stands alone"), ("{0}", "a brace stands alone")):
        assert why in one(spark, bad, lambda c: pv.template_error(c, ["a"]))
        with pytest.raises(Exception, match=why):
            one(spark, bad, lambda c: pv.rendered_prompt(c, {"a": F.lit("v")}))
    assert one(spark, "{b} {{x}} {a} {b}", pv.placeholders) == ["b", "a"]
    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, content_hash string")
    assert pv.combined_hash(rows).first()[0] == pv.combined_hash(rows.orderBy("name")).first()[0]


def test_refusals(spark):
    body = '{"error": {"message": "You exceeded your current quota", "details": "%s", "retryDelay": "43.5s"}}'
    for quota, limited, exhausted in (("GenerateRequestsPerMinute", True, False), ("requests_per_day", False, True), ("", False, True)):
        text = body % quota
        assert one(spark, text, lambda c: classify.rate_limited(F.lit(429), c)) is limited
        assert one(spark, text, lambda c: classify.quota_exhausted(F.lit(429), c)) is exhausted
        assert one(spark, text, lambda c: classify.quota_exhausted(F.lit(500), c)) is False
    assert one(spark, body, tx.stated_retry_seconds) == 43.5 and one(spark, "x", tx.stated_retry_seconds) is None
    assert one(spark, "99", lambda c: pv.retry_delay(F.lit(429), c)) == 30.0 and one(spark, None, lambda c: pv.retry_delay(F.lit(429), c)) is None
    assert one(spark, None, lambda c: pv.retry_delay(F.lit(503), c)) == 1.0 and one(spark, "1", lambda c: pv.retry_delay(F.lit(404), c)) is None
    assert one(spark, '{"message": "m"}', pv.error_message) == "m" and one(spark, "<html>", pv.error_message) == "<html>"
    assert one(spark, {"a": "1", "My_API_KEY": "2"}, pv.without_sensitive, "map<string,string>") == {"a": "1"}


def test_updates(spark):
    cases = spark.createDataFrame([("a", ["x"], "", False), ("b", [], None, True)], "case_id string, tags array<string>, notes string, verified_by_human boolean")
    done = spark.createDataFrame([("a", True, "seen")], "case_id string, smoke boolean, note string")
    out = {r.case_id: tuple(r) for r in pv.updated(cases, done).collect()}
    assert out == {"a": ("a", ["x", "smoke"], "seen", True), "b": ("b", [], None, True)}
    again = {r.case_id: r.tags for r in pv.updated(pv.updated(cases, done), done).collect()}
    assert again["a"] == ["x", "smoke"]
    assert pv.latest_manifest_differs(cases, cases) is False and pv.latest_manifest_differs(cases, cases.limit(1)) is True
