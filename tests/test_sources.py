import json
import zipfile

import pytest
from pyspark.sql import functions as F

from emberline.sources import cases as src


def payload(case_id, **more):
    case = {"schema_version": 1, "case_id": case_id, "title": "t", "inputs": {"repo": "acme/widget", "run_id": 31063661240, "head_sha": "0" * 40, "failed_job_name": "tests", "log_files": ["logs/b.txt", "logs/a.txt"]}, "ground_truth": {"failure_class": "code_change", "subcategory": "test_assertion", "related_to_diff": True, "culprit_files": []}, "provenance": {"source": "synthetic", "labeling_method": "constructed", "verified_by_human": False}, "verification": {"method": "none"}, "tags": []}
    return case | more


@pytest.fixture
def folder(tmp_path):
    for name, tags, diff in (("c-1", ["smoke"], "d.patch"), ("c-2", [], None)):
        d = tmp_path / "cases" / name
        (d / "logs").mkdir(parents=True)
        case = payload(name, tags=tags)
        case["inputs"]["diff_file"] = diff
        (d / "case.json").write_text(json.dumps(case))
        (d / "logs/a.txt").write_bytes(b"one\r\ntwo\xff\r")
        (d / "logs/b.txt").write_text("bee")
    (tmp_path / "cases/c-1/d.patch").write_text("+x\n")
    return str(tmp_path / "cases")


def test_cases_and_their_files(spark, folder):
    rows = src.load_cases(spark, folder)
    assert {r.case_id: r.inputs.run_id for r in rows.collect()} == {"c-1": 31063661240, "c-2": 31063661240}
    assert [r.case_id for r in src.load_cases(spark, folder, "smoke").collect()] == ["c-1"]
    with pytest.raises(ValueError):
        src.load_cases(spark, folder, "other")
    assert src.repeated_ids(rows).count() == 0 and src.repeated_ids(rows.union(rows)).count() == 2 and src.misplaced(rows).count() == 0
    files = src.text_files(spark, folder)
    logs = {r.case_id: r.log for r in src.case_logs(rows, files).collect()}
    assert logs["c-1"] == "bee\none\ntwo\ufffd\n"
    assert {r.case_id: r["diff"] for r in src.case_diffs(rows, files).collect()} == {"c-1": "+x\n", "c-2": None}
    assert src.missing_files(rows, files).count() == 0
    assert [tuple(r) for r in src.missing_files(rows, files.where(~F.endswith("path", F.lit("c-2/logs/a.txt")))).collect()] == [("c-2", "logs/a.txt")]


def test_paths_that_escape(spark):
    rows = spark.createDataFrame([("a/../b",), ("../a",), ("a/../../b/c",), ("/etc",), ("C:\\x",), ("a\\..\\..\\b",), ("./a",)], "p string")
    assert [r.e for r in rows.select(src.escapes(F.col("p")).alias("e")).collect()] == [False, True, True, True, True, True, False]


def test_attempts_and_controls(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text(json.dumps({"attempts": [{"case_id": "x", "attempted": True, "level": "LINTS"}, {"case_id": "y", "level": None}, {"case_id": "z", "attempted": True, "level": 4}]}))
    (tmp_path / "a/2.json").write_text(json.dumps({"other": 1}))
    got = {r.case_id: (r.attempted, r.level, r.localized) for r in src.read_attempts(spark, str(tmp_path / "a")).collect()}
    assert got == {"x": (True, 2, False), "y": (False, 0, False), "z": (True, 4, False)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.json").write_text(json.dumps({"n_usable": 1, "cases": [{"case_id": "x", "usable": True}, {"case_id": "y", "usable": None}]}))
    (tmp_path / "c/2.json").write_text(json.dumps({"cases": [{"case_id": "q", "usable": False}]}))
    rows = src.read_controls(spark, str(tmp_path / "c"))
    assert rows.count() == 2 and [r.case_id for r in src.unmeasurable(rows).collect()] == ["y"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("job/1_step.txt", "log")
        z.writestr("job/x.bin", "no")
    (tmp_path / "b.zip").write_bytes(b"broken")
    rows = src.archive_logs(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.entry or "", r.text or "", r.error is None) for r in rows) == [("", "", False), ("job/1_step.txt", "log", True)]
