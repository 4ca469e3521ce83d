"""Queries over what comes from outside: files of data sets and runs, payloads of hosting APIs, output of containers, prompts. With their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions import provider
from emberline.functions import text as tx
from emberline.operators import classify, compare, curate, patches, scoring
from emberline.sources import cases, views
from emberline.sources.workspace import new_path


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parts(spark, sf_dir)


def _choice(i: Column, *texts: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (i % len(texts) + 1).cast("int"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of images, repositories in slugs, and lists of failing tests."""
    i, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    tag = F.when(i % 4 == 0, F.concat(F.lit("own-er-repo"), n)).when(i % 4 == 1, F.lit("-7")).otherwise(F.concat(F.lit("acme-w-dget-"), n))
    slug = F.when(i % 3 == 0, F.concat(F.lit("acme-w-"), n)).when(i % 3 == 1, F.lit("plain")).otherwise("acme-")
    tests = F.concat(F.lit(" t::b # t::a##"), n, F.lit(" "))
    told = tx.parse_tag(tag)
    key = tx.bug_key(slug, tests)
    return _part(spark, sf_dir).select("p_partkey", told["slug"].alias("slug"), told["job_id"].alias("job_id"), tx.repo_name_from_slug(slug).alias("repo"), F.array_join(tx.parse_failing_tests(tests), "|").alias("tests"), F.array_join(key["tests"], "|").alias("bug"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extractions printed: good ones, repeated sections, no log, and the build's cache."""
    i, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    log = F.when(i % 5 == 0, "no log").when(i % 5 == 1, "").otherwise(F.concat(F.lit("log "), n))
    where = F.when(i % 7 == 0, "root=/home project=cacher").otherwise("root=/home/b project=acme/w log=/x=y")
    diff = F.concat(F.lit("diff -r /home/b/failed/acme/w/src/a.py /home/b/passed/acme/w/src/a.py\n--- /home/b/failed/acme/w/src/a.py\t2020\n+++ /home/b/passed/acme/w/src/a.py\t2020\n-"), n)
    output = F.concat(F.lit("noise\n=====CI_LOG=====\nfirst\n=====CI_log=====  \n"), log, F.lit("\n=====CI_LAYOUT=====\n"), where, F.lit("\n=====CI_DIFF=====\n"), diff, F.lit("\n=====CI_FILES=====\nsrc/a.py\n\n src/b.py \n"))
    tag = F.concat(F.lit("acme-w-"), n)
    a = patches.artifact(tag, output)
    return _part(spark, sf_dir).select("p_partkey", a.alias("a")).select("p_partkey", "a.slug", "a.job_id", "a.failing_log", F.md5("a.fix_diff").alias("diff_md5"), F.array_join("a.culprit_files", "|").alias("files"), "a.error")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of patches in containers: not applied, applied with the build failing, repaired, without a marker; and attempts that failed."""
    i, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    marker = F.when(i % 5 == 4, "").otherwise(F.concat(F.lit("##APPLIED## "), _choice(i, "0", "1", "2", " 2 "), F.lit("\n")))
    output = F.concat(F.lit("##APPLIED## 1\nhunk "), n, F.lit("\n"), marker, F.repeat(F.lit("x"), (i % 3 * 400).cast("int")), F.lit(" done"))
    result = provider.apply_result((i % 3 % 2).cast("int"), output, "##APPLIED##")
    rows = _part(spark, sf_dir).select("p_partkey", result.alias("r"), output.alias("o"), scoring.attempt_error(F.lit("ValueError"), F.repeat("p_name", F.lit(20))).alias("skip_reason"))
    v = provider.verification(F.col("r"), F.col("o"))
    return rows.select("p_partkey", "r.applied", "r.needed_repair", "r.build_passed", "r.apply_output", v["level"].alias("level"), v["detail"].alias("detail"), F.md5(v["evidence"]).alias("evidence_md5"), "skip_reason")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, names, conclusions, error messages, delays and attributes out of payloads."""
    i, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    steps = F.concat(F.lit('[{"number": 1, "name": "Set up", "conclusion": "success"}, {"number": 2, "name": "Test", "conclusion": "'), _choice(i, "failure", "new_kind", "cancelled"), F.lit('"}]'))
    payload = F.when(i % 6 == 5, F.lit('{"id": 5, "name": "bare"}')).otherwise(F.concat(F.lit('{"id": '), n, F.lit(', "name": "build", "conclusion": "failure", "steps": '), steps, F.lit("}")))
    j = provider.job(payload)
    body = F.when(i % 2 == 0, F.concat(F.lit('{"message": "no such '), n, F.lit('"}'))).otherwise(F.concat(F.lit("<html>"), F.repeat(n, F.lit(100))))
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 403, 429, 500, 503)]), (i % 5 + 1).cast("int"))
    held = F.create_map(F.lit("model"), n, F.lit("X-Api_Key"), F.lit("s"), F.lit("user_PASSWORD"), F.lit("s"), F.lit("tokens"), F.lit("5"))
    kept = F.array_join(F.array_sort(F.map_keys(provider.without_sensitive(held))), "|")
    return _part(spark, sf_dir).select("p_partkey", j.alias("j"), provider.workflow_name(_choice(i, "", "CI", None), _choice(i + 1, "ci.yml", "", None)).alias("workflow"), F.md5(provider.error_message(body)).alias("message_md5"), provider.retry_delay(status, _choice(i, "5", "-2", "90", None, "soon")).alias("delay"), kept.alias("attributes")).select(
        "p_partkey", F.col("j.job_id").alias("job_id"), F.col("j.conclusion").alias("conclusion"), F.size("j.steps").alias("n_steps"), F.array_join(F.transform(provider.failed_steps(F.col("j.steps")), lambda s: s["name"]), "|").alias("failed"), F.get("j.steps", F.lit(1))["conclusion"].alias("second"), "workflow", "message_md5", "delay", "attributes"
    )


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pull request of each commit: the first open one, else the first."""
    i = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha"), i.alias("ordinal"), (i * 3).alias("number"), F.when(i % 4 == 0, "open").otherwise("closed").alias("state"))
    return provider.pull_of_commit(rows)


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that are in the taxonomy and can be located; refusals that pass and that don't; repositories that may be written to."""
    i = F.col("p_partkey")
    cls, sub = _choice(i, *registry.FAILURE_CLASSES, "bug", None), _choice(i, "runtime_error", "yaml_syntax", "randomness", "network_timeout", "x", None, "action_version")
    status = F.when(i % 4 == 3, 500).otherwise(429)
    body = _choice(i, "Requests_Per_Minute", "exceeded your current quota", "QUOTA_EXCEEDED per day", "slow down", "RPM, daily limit", None)
    repo, setting = _choice(i, "acme/w", " ACME/W ", "acme/ww", "", None), _choice(i, "acme/w", " acme/w , other/x", "", ",,", "Acme/W")
    asked, agree = (i % 4).cast("int"), (i % 3).cast("int")
    origin = F.struct((i % 10 == 0).alias("verified_by_human"), F.when(i % 9 != 0, asked).alias("independent_adjudications"), F.when(i % 8 != 0, agree).alias("adjudicators_agreeing"))
    return _part(spark, sf_dir).select("p_partkey", classify.valid_verdict(cls, sub).alias("valid"), classify.locatable(cls).alias("locatable"), classify.rate_limited(status, body).alias("limited"), classify.quota_exhausted(status, body).alias("exhausted"), F.coalesce(tx.may_write(repo, setting), F.lit(False)).alias("may_write"), curate.trusted(origin).alias("trusted"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of whether failures are related to their diffs."""
    i = F.col("case_id")
    rows = views.case_results(spark, sf_dir).select(F.when(i % 11 != 0, i % 3 == 0).alias("truth"), F.when(i % 13 != 0, i % 4 < 2).alias("told"))
    return scoring.binary_metrics(rows, "truth", "told")


def widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric of each model that differs most over days."""
    trials = scoring.headline(views.case_results(spark, sf_dir), ["model", "day"])
    rows = compare.widest(compare.spreads(trials, ["model"], ["accuracy", "coverage"]), ["model"])
    return rows.select("model", "metric", F.round("spread", 9).alias("spread"))


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates of one signal, two a repository, 50 in all: the limit is what the operator is for."""
    rows = views.candidates(spark, sf_dir)
    told = classify.signal(F.col("conclusion"), F.col("attempt"), F.col("rerun_passed"), F.col("failed_steps"))
    return curate.capped(rows.where(told == registry.SIGNALS[4]), "repo", 2, limit=50).select("repo", "ordinal")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt files of parts: front matter, bodies, hashes; some are none. The combined hash is over those that are."""
    i, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    end = F.when(i % 2 == 0, "\r\n").otherwise("\n")
    head = F.when(i % 7 == 0, F.concat(F.lit("version: v1"), end)).otherwise(F.concat(F.lit("id: p"), n, end, F.lit("# note"), end, F.lit("id: 'q"), n, F.lit("'"), end))
    raw = F.when(i % 11 == 0, F.lit("no fence")).otherwise(F.concat(F.lit("---"), end, head, F.lit("---"), end, F.lit("Say {"), n, F.lit("}"), end, F.lit("  ")))
    rows = _part(spark, sf_dir).select("p_partkey", provider.prompt(raw).alias("p"))
    good = rows.where("p IS NOT NULL").select(F.element_at("p.meta", "id").alias("name"), F.col("p.content_hash").alias("content_hash"))
    each = rows.select("p_partkey", F.element_at("p.meta", "id").alias("name"), F.col("p.content_hash").alias("hash"), F.col("p.body").alias("body"))
    return each.unionByName(provider.combined_hash(good).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("all").alias("name"), F.col("combined_hash").alias("hash"), F.lit(None).cast("string").alias("body")))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cases name, and whether any leaves its folder."""
    i = F.col("p_partkey")
    inputs = F.struct(F.when(i % 5 != 0, F.array(F.lit("logs/a.txt"), _choice(i, "logs/b.txt", "a/../b", "../x", "/etc/x"))).alias("log_files"), F.when(i % 2 == 0, "d.patch").alias("diff_file"), F.when(i % 3 == 0, "w\\..\\..\\x").alias("workflow_file"), F.lit(None).cast("string").alias("passing_run_log"))
    files = cases.referenced_files(inputs)
    return _part(spark, sf_dir).select("p_partkey", F.array_join(files, "|").alias("files"), F.exists(files, cases.escapes).alias("escapes"))


def attempt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts written as JSON files, one document each, and read from there, without cases that a control, also in a file, found unusable."""
    root, i = new_path(spark, "attempts"), F.col("o_orderkey")
    orders = views.table(spark, sf_dir, "orders")
    level = F.element_at(F.array(*[F.lit(x) for x in ("LINTS", "applies", "4", None, "unknown")]), (i % 5 + 1).cast("int"))
    one = F.struct(F.concat(F.lit("c-"), i.cast("string")).alias("case_id"), F.when(i % 3 != 0, i % 2 == 0).alias("attempted"), level.alias("level"))
    orders.groupBy((i % 64).alias("file")).agg(F.collect_list(one).alias("attempts")).write.partitionBy("file").json(f"{root}/a")
    control = F.struct(F.concat(F.lit("c-"), i.cast("string")).alias("case_id"), F.when(i % 8 != 0, i % 4 != 1).alias("usable"))
    orders.groupBy((i % 64).alias("file")).agg(F.collect_list(control).alias("cases"), F.count_if(i % 4 != 1).cast("int").alias("n_usable")).write.partitionBy("file").json(f"{root}/c")
    bad = cases.unmeasurable(cases.read_controls(spark, f"{root}/c"))
    return cases.read_attempts(spark, f"{root}/a").join(bad, "case_id", "left_anti").select("case_id", "attempted", "level")


def card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards by day, written by model and prompt, and their names as files."""
    path = new_path(spark, "cards")
    cards = scoring.headline(views.case_results(spark, sf_dir), ["model", "day"]).select("day", F.concat("model", F.lit("/v:1")).alias("model"), F.lit("p1").alias("prompt_hash"), F.left(F.md5("day"), F.lit(7)).alias("git_sha"), "n_cases")
    cases.write_scorecards(cards, path)
    return spark.read.parquet(path).select("model", "prompt_hash", "file_name", "n_cases")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of suppliers' cases, written line by line, and read."""
    i = F.col("s_suppkey")
    truth, origin = F.struct(_choice(i, *registry.FAILURE_CLASSES).alias("failure_class")), F.struct(F.lit("synthetic").alias("source"))
    made = F.to_json(F.struct(F.concat(F.lit("c-"), F.lpad(i.cast("string"), 7, "0")).alias("case_id"), F.lit("t").alias("title"), truth.alias("ground_truth"), origin.alias("provenance"), F.when(i % 2 == 0, F.array(F.lit("smoke"), F.lit('"x"'))).alias("tags")))
    rows = views.table(spark, sf_dir, "supplier").select(F.from_json(made, cases.CASE).alias("c")).select("c.*")
    path = new_path(spark, "manifest")
    cases.write_manifest(curate.manifest_lines(rows), path)
    return cases.read_manifest(spark, path).select("case_count", F.posexplode("cases").alias("place", "c")).select("case_count", "place", "c.case_id", "c.failure_class", "c.source", F.array_join("c.tags", "|").alias("tags"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j_tags": tags, "j_artifacts": artifacts, "f_containers": containers, "j_payloads": payloads, "j_pulls": pulls, "k_predicates": predicates, "a_related": related, "t_widest": widest,
    "d_first_candidates": first_candidates, "h_prompts": prompts, "s_paths": paths, "s_attempt_files": attempt_files, "s_card_files": card_files, "s_manifests": manifests,
}

_N = "CAST(p_partkey AS VARCHAR)"


def _chosen(i: str, *texts: str | None) -> str:
    return "[" + ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts) + f"][{i} % {len(texts)} + 1]"


_VALID = " OR ".join(f"(c = '{c}' AND s IN ({', '.join(repr(x) for x in subs)}))" for c, subs in registry.SUBCATEGORIES.items())

ORACLE_SQL: dict[str, str] = {
    "j_tags": f"""SELECT p_partkey, CASE WHEN p_partkey % 4 >= 2 THEN 'acme-w-dget' END AS slug, CASE WHEN p_partkey % 4 >= 2 THEN p_partkey END AS job_id,
    ['w-' || {_N}, 'plain', 'acme-'][p_partkey % 3 + 1] AS repo, 't::b|t::a|' || {_N} AS tests, ' t::a| t::b |' || {_N} || ' ' AS bug FROM part""",
    "j_artifacts": f"""WITH p AS (SELECT p_partkey, p_partkey % 5 < 2 AS no_log, p_partkey % 7 = 0 AS cache, CASE WHEN p_partkey % 7 = 0 THEN 'root=/home project=cacher' ELSE 'root=/home/b project=acme/w log=/x=y' END AS w FROM part)
        SELECT p_partkey, 'acme-w' AS slug, p_partkey AS job_id, CASE WHEN NOT no_log AND NOT cache THEN 'log ' || {_N} END AS failing_log,
            CASE WHEN NOT no_log AND NOT cache THEN md5('diff --git a/src/a.py b/src/a.py' || chr(10) || '--- a/src/a.py' || chr(10) || '+++ b/src/a.py' || chr(10) || '-' || {_N}) END AS diff_md5,
            CASE WHEN NOT no_log AND NOT cache THEN 'src/a.py|src/b.py' END AS files,
            CASE WHEN no_log THEN 'acme-w-' || {_N} || ' has no original build log (' || w || ')' WHEN cache THEN 'acme-w-' || {_N} || ' resolved to the build cache, not a checkout (' || w || ')' END AS error FROM p""",
    "f_containers": f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE [0, 1, 2, 2][p_partkey % 4 + 1] END AS code, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE '##APPLIED## ' || ['0', '1', '2', ' 2 '][p_partkey % 4 + 1] || chr(10) END AS mark FROM part),
        o AS (SELECT *, '##APPLIED## 1' || chr(10) || 'hunk ' || {_N} || chr(10) || mark || repeat('x', p_partkey % 3 * 400) || ' done' AS o, coalesce(code IN (0, 2), false) AS applied, coalesce(code = 2, false) AS repaired, CASE WHEN code IS NULL THEN '' ELSE '##APPLIED## 1' || chr(10) || 'hunk ' || {_N} END AS before FROM p),
        b AS (SELECT *, applied AND p_partkey % 3 % 2 = 0 AS passed FROM o)
        SELECT p_partkey, applied, repaired AS needed_repair, passed AS build_passed, before AS apply_output, CAST(CASE WHEN NOT applied THEN 0 WHEN NOT passed THEN 1 ELSE 4 END AS INTEGER) AS level,
            CASE WHEN NOT applied THEN 'patch does not apply' ELSE CASE WHEN passed THEN 'the original job passes with the patch applied' ELSE 'patch applies' END || CASE WHEN repaired THEN ' after repairing its hunk headers' ELSE '' END || CASE WHEN passed THEN '' ELSE ' but the build still fails' END END AS detail,
            md5(CASE WHEN NOT applied THEN before ELSE right(o, 800) END) AS evidence_md5, left('ValueError: ' || repeat(p_name, 20), 300) AS skip_reason FROM b""",
    "j_payloads": f"""WITH p AS (SELECT *, p_partkey % 6 = 5 AS bare, ['failure', NULL, 'cancelled'][p_partkey % 3 + 1] AS c FROM part)
        SELECT p_partkey, CASE WHEN bare THEN 5 ELSE p_partkey END AS job_id, CASE WHEN NOT bare THEN 'failure' END AS conclusion, CAST(CASE WHEN bare THEN 0 ELSE 2 END AS INTEGER) AS n_steps, CASE WHEN NOT bare AND c = 'failure' THEN 'Test' ELSE '' END AS failed, CASE WHEN NOT bare THEN c END AS second,
            coalesce(nullif({_chosen('p_partkey', '', 'CI', None)}, ''), nullif({_chosen('(p_partkey + 1)', 'ci.yml', '', None)}, ''), '') AS workflow,
            md5(CASE WHEN p_partkey % 2 = 0 THEN 'no such ' || {_N} ELSE left('<html>' || repeat({_N}, 100), 200) END) AS message_md5,
            CASE p_partkey % 5 WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN 30 WHEN 3 THEN 1 WHEN 4 THEN 1 END AS delay, 'model|tokens' AS attributes FROM p""",
    "j_pulls": "SELECT o_custkey AS sha, 3 * coalesce(min(o_orderkey) FILTER (o_orderkey % 4 = 0), min(o_orderkey)) AS number FROM orders GROUP BY 1",
    "k_predicates": f"""WITH p AS (SELECT p_partkey AS i, {_chosen('p_partkey', *registry.FAILURE_CLASSES, 'bug', None)} AS c, {_chosen('p_partkey', 'runtime_error', 'yaml_syntax', 'randomness', 'network_timeout', 'x', None, 'action_version')} AS s FROM part)
        SELECT i AS p_partkey, coalesce({_VALID}, false) AS valid, c NOT IN ('flaky_test', 'infra_environment') AS locatable, i % 4 <> 3 AND i % 6 = 0 AS limited, i % 4 <> 3 AND i % 6 IN (1, 2) AS exhausted,
            (i % 5 = 0) OR (i % 5 = 1) AS may_write, i % 10 = 0 OR (CASE WHEN i % 9 <> 0 THEN i % 4 ELSE 0 END >= 2 AND CASE WHEN i % 9 <> 0 THEN i % 4 ELSE 0 END = CASE WHEN i % 8 <> 0 THEN i % 3 ELSE 0 END) AS trusted FROM p""",
    "a_related": """WITH r AS (SELECT event_id % 3 = 0 AS t, event_id % 4 < 2 AS p FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0), s AS (SELECT count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM r)
        SELECT CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1, n FROM s""",
    "h_prompts": f"""WITH p AS (SELECT p_partkey, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AS good, 'Say {{' || {_N} || '}}' AS body FROM part), h AS (SELECT p_partkey, CASE WHEN good THEN 'q' || {_N} END AS name, CASE WHEN good THEN left(sha256(body), 12) END AS hash, CASE WHEN good THEN body END AS body FROM p)
        SELECT * FROM h UNION ALL SELECT -1, 'all', left(sha256(string_agg(name || ':' || hash, '|' ORDER BY name)), 12), NULL FROM h WHERE hash IS NOT NULL""",
    "s_paths": f"""SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 5 <> 0 THEN 'logs/a.txt|' || {_chosen('p_partkey', 'logs/b.txt', 'a/../b', '../x', '/etc/x')} END, CASE WHEN p_partkey % 2 = 0 THEN 'd.patch' END, CASE WHEN p_partkey % 3 = 0 THEN 'w' || chr(92) || '..' || chr(92) || '..' || chr(92) || 'x' END) AS files,
        (p_partkey % 5 <> 0 AND p_partkey % 4 >= 2) OR p_partkey % 3 = 0 AS escapes FROM part""",
    "s_attempt_files": """SELECT 'c-' || o_orderkey AS case_id, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AS attempted, CAST([2, 1, 4, 0, 0][o_orderkey % 5 + 1] AS INTEGER) AS level FROM orders WHERE o_orderkey % 8 <> 0 AND o_orderkey % 4 <> 1""",
    "s_card_files": """SELECT event_type || '/v:1' AS model, 'p1' AS prompt_hash, left(md5(strftime(ts, '%Y-%m-%d')), 7) || '-' || event_type || '-v-1-p1.json' AS file_name, count(*) AS n_cases FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')""",
    "s_manifests": f"""SELECT (SELECT count(*) FROM supplier) AS case_count, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS place, 'c-' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS case_id, {_chosen('s_suppkey', *registry.FAILURE_CLASSES)} AS failure_class, 'synthetic' AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'smoke|"x"' ELSE '' END AS tags FROM supplier""",
}
