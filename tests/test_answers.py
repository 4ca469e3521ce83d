import json

import pytest
from pyspark.sql import functions as F

from emberline.functions import answers as an

GOOD = {"failure_class": "code_change", "subcategory": "lint_or_format", "related_to_diff": True, "confidence": 0.5, "evidence": ["a", "b"], "reasoning": "r"}


def but(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v is not ...})


CASES = {
    but(): [],
    "Here you are:\n```json\n" + but(extra=[1]) + "\n```": [],
    but(evidence=..., reasoning=...): [],
    but(related_to_diff="Yes", confidence="0.25"): [],
    but(related_to_diff=0, confidence=True): [],
    but(related_to_diff=2): [("related_to_diff", "must be true or false", "2")],
    but(related_to_diff=None): [("related_to_diff", "must be true or false", "null")],
    but(confidence=1.5): [("confidence", "must be at most 1", "1.5")],
    but(confidence=-1): [("confidence", "must be at least 0", "-1")],
    but(confidence="high"): [("confidence", "must be a number", "high")],
    but(failure_class="bug", subcategory=7): [("failure_class", "must be one of code_change, flaky_test, infra_environment, pipeline_config", "bug"), ("subcategory", "must be a text", "7")],
    but(failure_class=..., confidence=...): [("failure_class", "is missing", None), ("confidence", "is missing", None)],
    but(evidence="one"): [("evidence", "must be a list of texts", "one")],
    but(evidence=["one", 2]): [("evidence", "must be a list of texts", '["one",2]')],
    "no JSON at all": [("", "must be a JSON object", "no JSON at all")],
    '{"failure_class": "code_change", ': [("", "must be a JSON object", '{"failure_class": "code_change",')],
    "[1, 2]": [("", "must be a JSON object", "[1, 2]")],
    "": [("", "must be a JSON object", "")],
}


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, text string")
    return an.checked(frame, "text").orderBy("i").collect()


def test_every_rule(rows):
    for (text, want), r in zip(CASES.items(), rows, strict=False):
        assert sorted((tuple(e) for e in r.checked.errors), key=str) == sorted(want, key=str), text
        assert r.checked.valid == (not want)
    assert [tuple(e) for e in rows[-1].checked.errors] == [("", "must be a JSON object", "")]


def test_values(rows):
    assert rows[0].checked.value.asDict() == GOOD
    assert (rows[3].checked.value.related_to_diff, rows[3].checked.value.confidence) == (True, 0.25)
    assert (rows[4].checked.value.related_to_diff, rows[4].checked.value.confidence) == (False, 1.0)
    assert rows[2].checked.value.evidence is None and rows[14].checked.value is None


def test_lists_of_objects(spark):
    told = {"ranked_files": [{"path": "a.py", "confidence": 0.5}, {"path": 3, "confidence": 7, "why": None}, {}]}
    texts = [json.dumps(told), json.dumps({"ranked_files": [1]}), "{}", json.dumps({"ranked_files": [{"path": "x", "confidence": "1"}]})]
    got = [r.checked for r in an.checked(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", an.LOCALIZATION).orderBy("i").collect()]
    assert {(e.field, e.rule) for e in got[0].errors} == {("ranked_files.1.path", "must be a text"), ("ranked_files.1.confidence", "must be at most 1"), ("ranked_files.1.why", "must be a text"), ("ranked_files.2.path", "is missing"), ("ranked_files.2.confidence", "is missing")}
    assert [tuple(e) for e in got[1].errors] == [("ranked_files", "must be a list of objects", "[1]")]
    assert got[2].valid and got[2].value.ranked_files is None
    assert [tuple(f) for f in got[3].value.ranked_files] == [("x", 1.0, None)]


def test_one_repair(spark):
    bad, good = but(confidence=3), but(confidence=1)
    tries = {"first": [good, bad], "second": [bad, good], "never": [bad, "?", good], "once": ["?"]}
    rows = [(r, 5 * i, t, 10, 1) for r, texts in tries.items() for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "request_id string, attempt int, text string, input_tokens long, output_tokens long")
    got = {r.request_id: r for r in an.settled(frame).collect()}
    assert {k: (r.value is not None, r.repaired, r.n_answers, r.input_tokens) for k, r in got.items()} == {"first": (True, False, 1, 10), "second": (True, True, 2, 20), "never": (False, False, 2, 20), "once": (False, False, 1, 10)}
    assert got["never"].error == "TriageVerdict did not validate after 2 attempts: the answer must be a JSON object, got ?" and got["second"].error is None


def test_feedback_and_rows(spark):
    frame = an.checked(spark.createDataFrame([(1, "?"), (2, but()), (3, but(confidence=...))], "i int, text string"), "text")
    told = frame.where("i = 3").select(an.feedback(F.col("text"), F.col("checked.errors")).alias("f")).collect()[0].f
    assert told.startswith("Your previous answer did not match the required schema.\nAnswer was:\n{") and "\n\nErrors:\nconfidence is missing\n\nReply with" in told
    assert sorted((r.i, r.field, r.rule) for r in an.error_rows(frame, ["i"]).collect()) == [(1, "", "must be a JSON object"), (3, "confidence", "is missing")]


def test_subcategories_of_other_classes(spark):
    frame = spark.createDataFrame([("flaky_test", "randomness"), ("flaky_test", "yaml_syntax"), (None, "x")], "c string, s string")
    assert [r.e for r in frame.select(an.taxonomy_error(F.col("c"), F.col("s")).alias("e")).collect()] == [None, "'yaml_syntax' is not a subcategory of flaky_test. Expected one of: async_wait, concurrency, network_flakiness, randomness, resource_leak, test_order_dependency", None]
