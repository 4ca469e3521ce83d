from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators import patches as px

PATCH = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\t2026\n@@ -1 +1 @@\n-x\n+y\ndiff --git a/n b/m\n--- /dev/null\n+++ b/m\n+++ b/m\n+z\n"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_reads(spark):
    assert one(spark, PATCH, px.touched_paths) == ["src/a.py", "m"]
    assert one(spark, PATCH, px.changed_line_count) == 3
    assert one(spark, PATCH, px.diff_paths) == ["src/a.py", "m"]
    assert one(spark, "a\r\nb\x0bc", px.all_lines) == ["a", "b", "c"] and one(spark, "", px.all_lines) == []
    assert one(spark, PATCH, lambda c: px.diff_section(c, F.lit("m"))).startswith("diff --git a/n b/m\n")
    assert one(spark, PATCH, lambda c: px.diff_section(c, F.lit("q"))) == "not found: q is not in the diff"
    assert one(spark, PATCH, lambda c: px.diff_section(c, F.lit("m"), 20)) == "diff --git a/n b/m\n-\n...[hunk truncated]"
    assert one(spark, PATCH, px.listed_files) == "src/a.py\nm"
    for none in (None, ""):
        assert one(spark, none, px.listed_files) == one(spark, none, lambda c: px.diff_section(c, F.lit("m"))) == "not found: this case carries no diff"
    assert one(spark, "a\r\nb", px.normalize_patch) == "a\nb\n" and one(spark, "", px.normalize_patch) == "" and one(spark, " \r\n", px.normalize_patch) == " \r\n"


def test_policy(spark):
    check = lambda text, c="code_change": one(spark, text, lambda t: px.check_patch(t, F.lit(c)))
    assert check(" \n") == "empty" and check(PATCH) is None
    assert check("".join(f"+++ b/{i}\n" for i in range(6))) == "too_many_files"
    assert check("+l\n" * 201) == "too_many_lines" and check("+l\n" * 200) is None
    assert check("+ghp_abcdefghijklmnop1\n") == "secret" and check('+api_key = "abcdefghijkl"\n') == "secret"
    assert check("+++ b/.github/workflows/a.yml\n") == "workflow_edit" and check("+++ b/.github/workflows/a.yml\n", "pipeline_config") is None


def test_log_reads(spark):
    log = "\n".join(f"l{i}" for i in range(1, 501))
    got = one(spark, log, lambda c: px.log_range(c, F.lit(10), F.lit(400)))
    assert got.startswith("[lines 10-209 of 500 (truncated)]\nl10\n") and got.endswith("\nl209")
    assert one(spark, log, lambda c: px.log_range(c, F.lit(499), F.lit(520))) == "[lines 499-500 of 500]\nl499\nl500"
    for start in (0, -3, 501):
        assert one(spark, log, lambda c, start=start: px.log_range(c, F.lit(start), F.lit(5))) == "not found: the log has lines 1 to 500"
    found = one(spark, log, lambda c: px.search_log(c, F.lit("l1")))
    assert len(found.hits) == 20 and found.hits[1].n == 10 and found.more == 91
    assert one(spark, log, lambda c: px.search_report(c, F.lit("l499"))) == "499: l499"
    assert one(spark, log, lambda c: px.search_report(c, F.lit("l1"))).endswith("\n...91 more matches")
    for needle in ("it's", 'a "b" it\'s', "back\\slash\tand\nline", "plain", 'double"'):
        assert one(spark, log, lambda c, needle=needle: px.search_report(c, F.lit(needle))) == f"not found: no line contains {needle!r}"


def test_corrupt_sections_and_paths(spark):
    assert one(spark, "--- a\n+++ b\n@@\n x\n-y", px.corrupted) == "--- a\n+++ b\n@@\n control_line_that_does_not_exist\n-y\n"
    assert one(spark, "skip\n=====CI_LOG=====\n1\r\n2\n =====CI_Diff===== \n=====CI_LOG=====\n3\n", px.sections) == {"diff": "", "log": "3\n"}
    known = F.array(*[F.lit(p) for p in ("src/a.py", "lib/u.py", "x/u.py", "lib/only.py")])
    for path, want in (("src/a.py", "src/a.py"), ("./src/a.py", "src/a.py"), ("b/src/a.py", "src/a.py"), ("only.py", "lib/only.py"), ("u.py", None), ("zz", None), ("a/src/a.py", "src/a.py"), ("./b/src\\a.py", "src/a.py"), ("b/lib/only.py", "lib/only.py"), ("src/b/a.py", None)):
        assert one(spark, path, lambda c: px.resolve_path(c, known)) == want
    assert one(spark, "a/src/app.py", lambda c: px.resolve_path(c, F.array(F.lit("pkg/src/app.py"), F.lit("other.py")))) == "pkg/src/app.py"


def test_artifacts(spark):
    text = "=====CI_LAYOUT=====\nroot=/r project=p log=/x\n=====CI_LOG=====\nboom\n=====CI_FILES=====\n a.py \n\nb.py\n=====CI_DIFF=====\n--- /r/failed/p/a.py\tx\n+++ /r/passed/p/a.py\n+1\n"
    good = one(spark, text, lambda c: px.artifact(F.lit("acme-w-7"), c))
    assert (good.slug, good.job_id, good.failing_log, good.culprit_files, good.error) == ("acme-w", 7, "boom", ["a.py", "b.py"], None)
    assert good.fix_diff == "--- a/a.py\n+++ b/a.py\n+1"
    for text, error in (("", "t-1 has no original build log (layout not reported)"), ("=====CI_LAYOUT=====\nroot=/q\n=====CI_LOG=====\nno log\n", "t-1 has no original build log (root=/q)"), ("=====CI_LAYOUT=====\nproject=cacher\n=====CI_LOG=====\nx\n", "t-1 resolved to the build cache, not a checkout (project=cacher)")):
        bad = one(spark, text, lambda c: px.artifact(F.lit("t-1"), c))
        assert (bad.error, bad.failing_log) == (error, None)


def test_scalars(spark):
    url = one(spark, "https://github.com/a/b/actions/runs/31063661240/attempts/2", tx.parse_run_url)
    assert tuple(url) == ("a/b", 31063661240, 2)
    for bad in ("https://example.com/a/b/actions/runs/1", "http://github.com/a/b/actions/runs/1", "https://github.com/a/b/actions/runs/1?a b", "https://github.com/a b/c/actions/runs/1", "https://github.com/a/b/actions/runs/1x"):
        assert one(spark, bad, tx.parse_run_url) is None
    far = one(spark, " https://github.com/a/b/actions/runs/12345678901234567890123/job/5/#x?y\n", tx.parse_run_url)
    assert tuple(far) == ("a/b", 12345678901234567890123, None)
    assert [one(spark, x, tx.repo_name_from_slug) for x in ("acme-w-12", "acme", "acme-", "-x")] == ["w-12", "acme", "acme-", "x"]
    assert one(spark, "x ```json\n{\"a\": 1}\n``` y", tx.extract_json) == '{"a": 1}' and one(spark, "a {b} c} d", tx.extract_json) == "{b} c}" and one(spark, " none ", tx.extract_json) == "none" and one(spark, "```\nx {\"a\": 1} y\n``` {b}", tx.extract_json) == '{"a": 1}' and one(spark, ' {"a": 1} trailing', tx.extract_json) == '{"a": 1} trailing'
    assert tuple(one(spark, "acme-w-12-345", tx.parse_tag)) == ("acme-w-12", 345) and one(spark, "acme", tx.parse_tag) is None
    assert one(spark, " \t.\\src\\a.py\n", tx.normalize_path) == "src/a.py"
    assert one(spark, "Org/Repo", lambda c: tx.may_write(c, F.lit(" org/repo , x/y,"))) is True and one(spark, "a/b", lambda c: tx.may_write(c, F.lit(""))) is False
    assert one(spark, "Run actions/Setup-node", tx.is_setup_step) is True and one(spark, "Setup", tx.is_setup_step) is False
    assert one(spark, "https://a/b?c#d", tx.redact_url) == "https://a/b"
