"""Logs of jobs and steps from archives, against a reading of them one by one."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from emberline.sources import archives as ar

LONG = "build (ubuntu-latest, python 3.13, with all extras and the slow tests that take the longest)"
assert len(LONG) > 85


def archive(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def best(names, job):
    target = job.replace("/", " ").replace(":", " ")
    if target in names:
        return target
    cut = [n for n in names if len(n) >= 80 and target.startswith(n)]
    return max(cut, key=len, default=None)


def plain_job(content, job):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {m["j"]: n for n in z.namelist() if "/" not in n and (m := re.fullmatch(r"\d+_(?P<j>.+)\.txt", n))}
        name = best(names, job)
        return z.read(names[name]).decode("utf-8", "replace") if name else None


def plain_step(content, job, step):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        folder = best({n.partition("/")[0] for n in z.namelist() if "/" in n} - {""}, job)
        for n in z.namelist() if folder else ():
            if n.startswith(f"{folder}/{step}_") and n.endswith(".txt"):
                return z.read(n).decode("utf-8", "replace")


ARCHIVES = {
    "a.zip": [("0_build.txt", "whole build\n"), ("1_test  unit.txt", "é tests"), (f"2_{LONG[:80]}.txt", "cut at 80"), (f"3_{LONG[:84]}.txt", "cut at 84"), ("notes.txt", "no"), ("0_lint.txt", "first"), ("7_lint.txt", "last"), ("build/1_Set up.txt", "set up"), ("build/10_Ten.txt", "ten"), ("build/1_Other.txt", "second one"), ("build/2_x.log", "no log"), (f"{LONG[:82]}/3_Go.txt", "long step")],
    "b.zip": [("0_builder.txt", "another"), ("build/", ""), ("builder/1_a.txt", b"bytes \xff here"), ("deep/er/1_x.txt", "deeper"), ("deep/1_y.txt", "deep")],
    "empty.zip": [],
}
JOBS = ["build", "builder", "test/:unit", LONG, LONG[:83], LONG + " and more", "lint", "none", "", "notes", "deep"]


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(p, archive(m)) for p, m in ARCHIVES.items()] + [("stored.zip", archive(ARCHIVES["a.zip"], zipfile.ZIP_STORED)), ("broken.zip", b"PK not a zip"), ("null.zip", None)]
    return spark.createDataFrame(rows, "path string, content binary"), dict(rows)


def test_job_logs(spark, stored):
    frame, contents = stored
    jobs = spark.createDataFrame([(p, j) for p in contents for j in JOBS], "path string, job string")
    got = {(r.path, r.job): r.text for r in ar.job_logs(frame, jobs).collect()}
    good = {p for p in contents if p not in ("broken.zip", "null.zip")}
    assert got == {(p, j): plain_job(contents[p], j) if p in good else None for p in contents for j in JOBS}
    assert got["a.zip", LONG] == "cut at 84" and got["a.zip", LONG[:83]] == "cut at 80" and got["a.zip", "lint"] == "last" and got["b.zip", "build"] is None


def test_step_logs(spark, stored):
    frame, contents = stored
    steps = [(p, j, n) for p in ("a.zip", "b.zip", "stored.zip", "broken.zip") for j in JOBS for n in (1, 2, 3, 10, 99)]
    got = {tuple(r)[:3]: r.text for r in ar.step_logs(frame, spark.createDataFrame(steps, "path string, job string, step int")).select("path", "job", "step", "text").collect()}
    assert got == {s: None if s[0] == "broken.zip" else plain_step(contents[s[0]], *s[1:]) for s in steps}
    assert got["a.zip", "build", 1] == "set up" and got["a.zip", "build", 10] == "ten" and got["a.zip", LONG, 3] == "long step" and got["b.zip", "builder", 1] == "bytes � here"


def test_index_reads_no_member_and_names_what_is_broken(spark, stored):
    frame, contents = stored
    rows = ar.index(frame).collect()
    assert {r.path for r in rows if r.error} == {"broken.zip", "null.zip"}
    assert {r.entry for r in rows if r.path == "a.zip"} == {n for n, _ in ARCHIVES["a.zip"]}
    damaged = bytearray(contents["a.zip"])
    at = next(r for r in rows if r.path == "a.zip" and r.entry == "0_build.txt")
    damaged[at.place + 30 + len(at.entry) + 2] ^= 0xFF
    frame = spark.createDataFrame([("d.zip", bytes(damaged))], "path string, content binary")
    got = {r.job: (r.text, r.error) for r in ar.job_logs(frame, spark.createDataFrame([("d.zip", "build"), ("d.zip", "lint")], "path string, job string")).collect()}
    assert got["lint"] == ("last", None) and got["build"][0] is None and got["build"][1]


def test_archives_come_back(spark):
    members = [("x.zip", i, n, t) for i, (n, t) in enumerate([("0_a.txt", "one"), ("a/1_b.txt", None), ("z/", "")])]
    frame = ar.pack(spark.createDataFrame(members, "path string, ord int, entry string, text string"))
    content = frame.collect()[0].content
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        assert z.namelist() == ["0_a.txt", "a/1_b.txt", "z/"] and z.read("a/1_b.txt") == b"" and z.testzip() is None
    assert ar.index(frame.where(F.lit(False))).count() == 0


def test_repeated_requests_keep_their_rows(spark, stored):
    jobs = spark.createDataFrame([("a.zip", "build")] * 3 + [("gone.zip", "build")], "path string, job string")
    assert sorted((r.path, r.text or "") for r in ar.job_logs(stored[0], jobs).collect()) == [("a.zip", "whole build\n")] * 3 + [("gone.zip", "")]
