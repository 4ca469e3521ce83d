import hashlib
import json
import random

import pytest

from emberline.operators import curate
from emberline.sources import cases as cs


def case(i, **more):
    return {
        "case_id": f"c-{i}", "title": f"Züge \U0001f600 \x1b \x0b \\u001B \"{i}\" /",
        "inputs": {"repo": "a/b", "run_id": 31063661240, "head_sha": "s", "failed_job_name": "j", "log_files": ["z.log", "a.log"], "diff_file": "d.diff"},
        "ground_truth": {"failure_class": "code_change", "subcategory": "lint_or_format", "related_to_diff": None},
        "provenance": {"source": "synthetic", "labeling_method": "constructed", "snapshot_date": "2026-01-02"},
        **more,
    }


def filled(c):
    """A case as JSON has it when every field is told."""
    none = dict.fromkeys
    return {
        "schema_version": 1, "case_id": c["case_id"], "title": c["title"], "tags": c.get("tags", []),
        "inputs": {"provider": "github_actions", "run_attempt": 1, **none(("pr_number", "failed_step_name", "diff_file", "workflow_file", "passing_run_log")), **c["inputs"]},
        "ground_truth": {"culprit_files": [], "failing_tests": [], **none(("fix_commit_sha", "fix_summary")), **c["ground_truth"]},
        "provenance": {"verified_by_human": False, "notes": "", "independent_adjudications": 0, "adjudicators_agreeing": 0, **none(("verified_date", "original_url")), **c["provenance"]},
        "verification": {"method": "none", "setup_commands": [], "timeout_seconds": 600, **none(("docker_image", "test_command", "no_new_breaks_command")), **c.get("verification", {})},
    }


@pytest.fixture
def folder(tmp_path):
    made = [case(2, tags=["x", "y"]), case(1), case(10, verification={"method": "bugswarm_image", "docker_image": "i:t", "test_command": "run"})]
    for c in made:
        at = tmp_path / "cases" / c["case_id"]
        at.mkdir(parents=True)
        (at / "case.json").write_text(json.dumps(c))
        for name in ("z.log", "a.log", "d.diff"):
            (at / name).write_bytes(f"{name} {c['case_id']}\r\n\xff".encode("latin-1"))
    return tmp_path, made


def digest(made, files):
    h = hashlib.sha256()
    for c in sorted(made, key=lambda c: c["case_id"]):
        h.update(json.dumps(filled(c), sort_keys=True, separators=(",", ":")).encode() + b"\0")
        for name in sorted(["z.log", "a.log", "d.diff"]) if files else []:
            text = f"{name} {c['case_id']}\n\ufffd"
            h.update(name.encode() + hashlib.sha256(text.encode()).hexdigest().encode() + b"\0")
    return h.hexdigest()[:12]


def test_hash_equals_a_plain_fold(spark, folder):
    path, made = folder
    cases = cs.load_cases(spark, str(path / "cases"))
    files = cs.text_files(spark, str(path / "cases"))
    assert [r.case_id for r in cases.collect()] == ["c-1", "c-10", "c-2"]
    assert curate.content_hash(curate.case_blocks(cases)).first()[0] == digest(made, False)
    assert curate.content_hash(curate.case_blocks(cases, files)).first()[0] == digest(made, True)


def test_manifest_round_trip(spark, folder, tmp_path):
    path, made = folder
    cases = cs.load_cases(spark, str(path / "cases"))
    row = curate.manifest(cases, cs.text_files(spark, str(path / "cases")))
    want = {"schema_version": 1, "dataset_hash": digest(made, True), "case_count": 3, "cases": [{"case_id": c["case_id"], "failure_class": "code_change", "source": "synthetic", "tags": c.get("tags", [])} for c in sorted(made, key=lambda c: c["case_id"])]}
    text = curate.manifest_text(row)
    assert text.first().value == json.dumps(want, indent=2) + "\n"
    cs.write_manifest(text, str(tmp_path / "out"))
    assert cs.read_manifest(spark, str(tmp_path / "out")).first().asDict(recursive=True) == want
    lines = curate.manifest_lines(cases, cs.text_files(spark, str(path / "cases")))
    cs.write_manifest(lines, str(tmp_path / "lines"))
    (written,) = (tmp_path / "lines").glob("part-*")
    assert written.read_text() == text.first().value
    none = curate.manifest_lines(cases.where("false"))
    assert "\n".join(r.value for r in none.orderBy("ord").collect()) + "\n" == curate.manifest_text(curate.manifest(cases.where("false"))).first().value
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        cs.read_manifest(spark, str(tmp_path / "bad.json"))


def test_json_of_signs_equals_pythons(spark):
    draw = random.Random(5)
    signs = ["a", "\\", '"', "\x0b", "\x1b", "\x1f", "\x7f", "\\u001B", "é", "漢", "\U0001f600", "\U0010ffff", "\u2028", "/", "\n", "\t", "\ud7ff"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "b long, a string")
    got = {r.b: r.j for r in rows.select("b", curate.canonical_json(rows, ["b", "a"]).alias("j")).collect()}
    assert got == {i: json.dumps({"a": t, "b": i}, separators=(",", ":")) for i, t in enumerate(texts)}


def test_a_digest_without_an_order(spark):
    rows = [(i % 50, f"d{i % 7}") for i in range(200)]
    one = lambda rs: curate.bucketed_hash(spark.createDataFrame(rs, "k long, d string").repartition(3), "k", "d").first()[0]
    assert one(rows) == one(rows[::-1]) != one(rows[:-1]) and one(rows) != one([*rows, rows[0]])
    assert len(curate.bucketed_hash(spark.createDataFrame([], "k long, d string"), "k", "d").first()[0]) == 12


def test_repeated_ids_are_an_error(spark, folder):
    path, _ = folder
    again = path / "cases" / "copy"
    again.mkdir()
    (again / "case.json").write_text(json.dumps(case(1)))
    with pytest.raises(ValueError, match="c-1"):
        cs.load_cases(spark, str(path / "cases"))
