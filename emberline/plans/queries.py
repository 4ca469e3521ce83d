"""Queries over the rendered CI tables, one for each group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions import answers as answers_fn
from emberline.functions import provider
from emberline.functions import text as tx
from emberline.operators import classify, compare, condense, curate, edits, evidence, expectations, patches, retries, run_totals, scoring, usage
from emberline.plans import outside
from emberline.sources import archives, case_folders, case_table, cases, views
from emberline.sources.usage_store import UsageStore
from emberline.sources.workspace import new_path


def condense_excerpts(spark: SparkSession, sf_dir: str, max_chars: int = registry.MAX_CHARS) -> DataFrame:
    rows = condense.condense_lines(views.numbered_lines(spark, sf_dir), max_chars=max_chars)
    return rows.select("log_id", "total_lines", "strategy", "start_line", "end_line", "reason", F.md5("text").alias("text_md5"))


def condense_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of logs that are one text each."""
    rows = condense.excerpt_rows(condense.condense(views.logs(spark, sf_dir), max_chars=2500))
    return rows.select("log_id", "total_lines", "strategy", "start_line", "end_line", "reason", F.md5("text").alias("text_md5"))


def condense_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 2,500 characters: the last windows that fit, or the tail."""
    return condense_excerpts(spark, sf_dir, 2500)


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.concat(F.when(i % 5 == 0, F.lit("﻿")).otherwise(""), F.when(i % 2 == 0, F.lit("2026-01-02T03:04:05.678Z ")).otherwise(""), F.lit("\u001b[31m"), "line", F.lit("\u001b[0m"), F.when(i % 3 == 0, F.lit("\r\n")).otherwise("\r"), F.lit("2026-01-02T03:04:05Z end"))
    return views.log_lines(spark, sf_dir).select("event_id", F.md5(tx.clean_log(raw)).alias("cleaned_md5"), F.size(tx.split_lines(tx.clean_log(raw))).alias("n_lines"))


def regex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.regex_classifier(views.log_lines(spark, sf_dir).withColumn("has_diff", F.col("event_id") % 2 == 0), log="line", has_diff="has_diff")
    return rows.groupBy("failure_class", "subcategory", "related_to_diff").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.majority_class(views.case_results(spark, sf_dir), "case_id")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.candidates(spark, sf_dir).withColumn("signal", classify.signal(F.col("conclusion"), F.col("attempt"), F.col("rerun_passed"), F.col("failed_steps")))
    return rows.groupBy("signal").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(views.case_results(spark, sf_dir), ["model"]).select("model", "truth_class", "predicted_class", "n")


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.class_metrics(views.case_results(spark, sf_dir), ["model"]).drop("ord")


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.headline(views.case_results(spark, sf_dir), ["model"])


def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.answer_rates(views.case_results(spark, sf_dir), ["model"])


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.case_results(spark, sf_dir)
    rows.createOrReplaceTempView("emberline_cases")
    return spark.sql("SELECT truth_class, model, count(*) AS n, count_if(correct) AS n_correct FROM emberline_cases GROUP BY GROUPING SETS ((truth_class), (model), ())")


def localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.localization(views.ranked_files(spark, sf_dir), ["status"])


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.ranked_files(spark, sf_dir).withColumn("rank", scoring.rank_of_first_hit(F.col("ranked"), F.col("truth")))
    return rows.groupBy("rank").agg(F.count("*").alias("n"), F.max("case_id").alias("last_case"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.funnel(views.attempts(spark, sf_dir), ["team"])


def funnel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.funnel_rows(scoring.funnel(views.attempts(spark, sf_dir)))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which a third of the cases is wrong against one in which a fifth is."""
    card = lambda wrong: scoring.headline(views.case_results(spark, sf_dir, wrong))
    return compare.gate(card(5), card(3), {"macro_f1": 0.02, "accuracy": 0.5})


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = compare.flips(views.case_results(spark, sf_dir, 5), views.case_results(spark, sf_dir, 3))
    return changed.groupBy("change").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"), F.sum("case_id").alias("cases"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(scoring.headline(views.case_results(spark, sf_dir), ["model"]))


def _cards(cards: DataFrame) -> DataFrame:
    return cards.select("model", F.length("model").alias("ordinal"), "coverage", "macro_f1", F.col("cost_weighted_error").alias("cost"), F.col("n_cases").cast("double").alias("seconds"), F.when(F.col("model") == "error", "failed").alias("error"))


def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ranked(_models(spark, sf_dir)).select("model", "place")


def model_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the cases that were answered, so that models are complete; one could not be scored."""
    cards = scoring.headline(views.case_results(spark, sf_dir).where("predicted_class IS NOT NULL"), ["model"])
    return compare.winners(_cards(cards))


def trial_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is a trial."""
    trials = scoring.headline(views.case_results(spark, sf_dir), ["model", "day"])
    rows = compare.spreads(trials, ["model"], ["accuracy", "macro_f1", "coverage"])
    return rows.select("model", "metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high", "spread", "stdev")])


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.capped(views.candidates(spark, sf_dir), "repo", 3).select("repo", "ordinal", "conclusion")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, existing = views.catalogue(spark, sf_dir)
    return curate.select_new(rows, existing.select("tag", "repo", "bug"), cap=8)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.reconcile(views.annotations(spark, sf_dir))
    return rows.select("slug", "agreed", "failure_class", "related_to_diff", F.array_join("culprit_files", "|").alias("culprits"), "confidence", "review")


def failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.candidates(spark, sf_dir).select(F.col("repo").alias("run_id"), "ordinal", F.when(F.col("ordinal") % 4 == 0, "success").otherwise(F.col("conclusion")).alias("conclusion"))
    return curate.failed_job(rows)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the case table: canonical JSON of each case, a NUL after it, in the order of its id."""
    # Making the JSON is the dear part; the table may be one file, and so one task.
    rows = views.case_results(spark, sf_dir).repartition("case_id").select(F.format_string("case-%09d", "case_id").alias("case_id"), "truth_class", "predicted_class", "correct", F.struct(F.col("model"), F.concat(F.col("day"), F.lit(" é\"")).alias("day")).alias("run"))
    return curate.content_hash(rows.select("case_id", F.concat(curate.canonical_json(rows, rows.columns), F.lit("\0")).alias("block")))


def bucketed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the case table that needs no order of rows."""
    rows = views.case_results(spark, sf_dir)
    return curate.bucketed_hash(rows.withColumn("digest", curate.row_digest(*[F.col(c) for c in rows.columns])), "case_id", "digest")


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.case_results(spark, sf_dir)
    return rows.select("case_id", curate.row_digest(F.col("case_id"), F.col("truth_class"), F.col("predicted_class")).alias("digest"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", patches.find_secret(F.col("text")).alias("pattern"))
    return docs.where("pattern IS NOT NULL")


def patch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("patch")
    return views.patches(spark, sf_dir).select("patch_id", F.array_join(patches.touched_paths(p), "|").alias("paths"), patches.changed_line_count(p).alias("changed_lines"), patches.check_patch(p, F.col("failure_class")).alias("refusal"))


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", tx.redact_url(F.col("url")).alias("redacted"))


def run_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    url = F.concat(F.lit("https://github.com/acme/w"), (i % 7).cast("string"), F.when(i % 9 == 0, "/pull/").otherwise("/actions/runs/"), (i * 1000003 + 31063661240).cast("string"), F.when(i % 4 == 0, F.concat(F.lit("/attempts/"), (i % 5 + 1).cast("string"))).otherwise(""))
    url = F.when(i % 13 == 0, F.replace(url, F.lit("https"), F.lit("http"))).when(i % 11 == 0, F.concat(F.lit("  "), url, F.lit("?a=1\n"))).when(i % 10 == 0, F.concat(url, F.lit("?a b"))).otherwise(url)
    rows = views.table(spark, sf_dir, "orders").select(i.alias("id"), tx.parse_run_url(url).alias("r"))
    return rows.select("id", "r.repo", F.col("r.run_id").cast("long").alias("run_id"), F.col("r.attempt").cast("int").alias("attempt"))


def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.costs(views.usage(spark, sf_dir)).select("model", "n_requests", "input_tokens", "output_tokens", F.round("list_price_usd", 9).alias("list_price_usd"), F.round("per_request_usd", 12).alias("per_request_usd"))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(views.usage(spark, sf_dir))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([("view", 80, None), ("click", None, 2000), ("error", 60, 1500), ("signup", 1000, None)], "provider string, rpd int, tpd int")
    return usage.preflight(usage.daily(views.usage(spark, sf_dir)), caps, needed=20)


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.searches(views.numbered_lines(spark, sf_dir), ["user 7"])
    return found.select("log_id", F.size("hits").alias("n_hits"), F.col("more").cast("int").alias("more"), F.get("hits", F.lit(0))["n"].alias("first_line"))


def repaired_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches whose header tells other counts than the hunk has. The fold over lines is Python; its SQL says what comes of these."""
    rows = views.patches(spark, sf_dir).withColumn("patch", F.replace("patch", F.lit("@@ -1,2 +1,2 @@"), F.lit("@@ -1,9 +1,7 @@")))
    rows = rows.select("patch_id", "patch", edits.repair_patch(F.col("patch")).alias("fixed"))
    return rows.select("patch_id", (F.col("fixed") != F.col("patch")).alias("needs_repair"), F.md5("fixed").alias("repaired_md5"))


def edited_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit of each part's text, exact for most and with other white space for some. The fold over edits is Python; its SQL says what comes of these."""
    part = views.parts(spark, sf_dir)
    text = F.concat(F.lit("name:\n    "), "p_name", F.lit("\n    "), "p_type", F.lit("\n"))
    find = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("  "), "p_name", F.lit("\n  "), "p_type", F.lit("\n"))).otherwise(F.col("p_type"))
    edit = F.struct(F.lit("b/src/p.txt").alias("path"), find.alias("find"), F.lit("changed").alias("replace"))
    cases_ = part.select(F.col("p_partkey").alias("case_id"), F.array(edit).alias("edits"), F.create_map(F.lit("src/p.txt"), text).alias("contents"))
    done = edits.patches_from_edits(cases_)
    return done.select("case_id", "patch", F.array_join("placed", "|").alias("placed"), F.array_join("missed", "|").alias("missed"), "ok", "report")


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each event type through a bucket."""
    events = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("request_id"), F.unix_timestamp("ts").cast("double").alias("at"))
    caps = spark.createDataFrame([("view", 1), ("click", 2), ("error", None)], "provider string, rpm int")
    return usage.token_bucket(events, caps)


def log_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that the cap cuts, that end beyond the log, that end before they start, and that start outside."""
    lines = views.numbered_lines(spark, sf_dir)
    told = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("first"), F.lit(b).alias("last")) for o, a, b in [(1, 3, 10), (2, 5, 900), (3, 40, 60), (4, 9, 2), (5, 0, 5), (6, 100000, 100001)]])
    wanted = lines.select("log_id").distinct().select("log_id", F.explode(told).alias("r")).select("log_id", "r.*")
    return evidence.ranges(lines, wanted).select("log_id", "ord", F.md5("text").alias("text_md5"))


def search_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = evidence.search_texts(views.numbered_lines(spark, sf_dir), ["user 7", "it's nowhere", 'neither "this" nor it\'s'])
    return texts.select("log_id", "ord", F.md5("text").alias("text_md5"))


def patch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches made right and made wrong, what files they list, and the part on one of them."""
    p, i = F.col("patch"), F.col("patch_id")
    raw = F.when(i % 3 == 0, F.replace(p, F.lit("\n"), F.lit("\r\n"))).when(i % 3 == 1, F.regexp_replace(p, "\n\\z", "")).otherwise(p)
    return views.patches(spark, sf_dir).select("patch_id", F.md5(patches.normalize_patch(raw)).alias("normalized_md5"), F.md5(patches.corrupted(p)).alias("corrupted_md5"), patches.listed_files(p).alias("files"), F.md5(patches.diff_section(p, F.lit("src/f3.py"), 120)).alias("section_md5"))


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    known = F.array(*[F.concat(F.lit(a), (i % k).cast("string"), F.lit(b)) for a, k, b in (("src/m", 5, ".py"), ("pkg/src/m", 7, ".py"), ("lib\\n", 3, ".py"))])
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "./", "a/", "b/", "./b/", "x/")]), (i % 6 + 1).cast("int")), F.when(i % 4 == 0, "lib/n").when(i % 4 == 1, "n").otherwise("src/m"), (i % 11).cast("string"), F.lit(".py"))
    return views.table(spark, sf_dir, "part").select("p_partkey", patches.resolve_path(path, known).alias("meant"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in answers: fenced, chatty, bare, none; and quotes of evidence."""
    i, name = F.col("p_partkey"), F.col("p_name")
    body = F.concat(F.lit('{"a": "'), name, F.lit('"}'))
    text = F.when(i % 5 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n``` and {more}"))).when(i % 5 == 1, F.concat(F.lit("I say "), body, F.lit(" or {} so"))).when(i % 5 == 2, F.concat(F.lit(" "), body, F.lit(" trailing\n"))).when(i % 5 == 3, F.concat(F.lit("``` "), name, F.lit("```"))).otherwise(name)
    evidence = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("`"), name, F.lit("`\n2nd")), F.lit(" \r "), F.repeat(name, F.lit(30)), F.lit("fourth")))
    return views.table(spark, sf_dir, "part").select("p_partkey", tx.extract_json(text).alias("json"), F.md5(tx.quote_evidence(evidence)).alias("quote_md5"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    files = F.create_map(F.lit("a.txt"), F.coalesce("text", F.lit("")), F.lit("b.txt"), F.lit("short"))
    return docs.select("doc_id", F.md5(tx.prompt_diff(F.col("text"))).alias("diff_md5"), F.md5(tx.prompt_files(files)).alias("files_md5"))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.case_results(spark, sf_dir)
    i = F.col("case_id")
    reason = classify.skip_reason(F.col("truth_class"), (i % 10) / 8, F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.py"))))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    runs = views.table(spark, sf_dir, "orders").select(i.alias("case_id"), F.when(i % 12 != 0, F.greatest(F.lit(0), (i % 8).cast("int") - 3)).alias("reference_level"), (i % 5).cast("int").alias("corrupted_level"))
    return scoring.control(runs)


def funnel_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 cases with an image whose control isn't unusable; whether what was ranked is on target, and the patch to verify."""
    i = F.col("case_id")
    check = F.struct(F.when(i % 3 == 0, "none").otherwise("bugswarm_image").alias("method"), F.when(i % 5 != 0, F.concat(F.lit("bugswarm/cached-images:t"), i.cast("string"))).alias("docker_image"))
    ranked = F.transform("ranked", lambda p: F.struct(p.alias("path")))
    cases = views.ranked_files(spark, sf_dir).withColumn("verification", check)
    unusable = scoring.control(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(4).alias("reference_level"), (F.col("o_orderkey") % 5).cast("int").alias("corrupted_level"))).where("NOT usable")
    kept = scoring.funnel_cases(cases, unusable, limit=40)
    edited = edits.edited_patch(F.struct((i % 2 == 0).alias("ok"), F.concat(F.lit("patch "), "image_tag").alias("patch")))
    return kept.select("case_id", "image_tag", scoring.on_target(scoring.ranked_paths(ranked), F.col("truth")).alias("on_target"), edited.alias("patch"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorecard for each status: classification by events, localization and funnel by orders."""
    named = F.when(F.col("case_id") % 3 == 0, "O").when(F.col("case_id") % 3 == 1, "F").otherwise("X").alias("status")
    results = views.case_results(spark, sf_dir).select("*", named)
    localized = views.ranked_files(spark, sf_dir)
    tried = views.attempts(spark, sf_dir).join(localized.select("case_id", "status"), "case_id")
    return scoring.scorecards(results, ["status"], localized, tried)


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two baseline models, which are forgiven nothing."""
    card = lambda wrong, subset: scoring.headline(views.case_results(spark, sf_dir, wrong)).withColumns({"subset": F.lit(subset), "dataset_hash": F.lit("abc")})
    a, b = card(5, "all"), card(3, "smoke")
    return compare.verdict(compare.gate(a, b, both_baselines=compare.both_baselines("baseline-regex", "baseline-majority")), compare.problems(a, b))


def model_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = scoring.headline(views.case_results(spark, sf_dir), ["model"]).select("model", F.length("model").alias("ordinal"), "n_answered", "n_cases", F.when(F.col("model") == "error", "no key").alias("error"))
    return compare.notes(models).select("kind", "note")


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cases made of orders hold: tags, repositories, bugs and how many of each."""
    i = F.col("o_orderkey")
    tests = F.when(i % 4 == 0, F.array(F.lit("t2"), F.lit(""), F.lit("t1"))).when(i % 4 == 1, F.array(F.lit("t1"), F.lit("t2")))
    cases = views.table(spark, sf_dir, "orders").select(F.struct(F.when(i % 6 != 0, F.concat(F.lit("r"), (i % 9).cast("string"))).alias("repo")).alias("inputs"), F.struct(tests.alias("failing_tests")).alias("ground_truth"), F.struct(F.when(i % 10 != 0, F.concat(F.lit("x:y:"), i.cast("string"))).otherwise("none").alias("docker_image")).alias("verification"))
    found = curate.existing_cases(cases)
    return found.groupBy("repo", F.array_join("bug.tests", "#").alias("tests")).agg(F.count("*").alias("n"), F.count("tag").alias("n_tags"), F.min("tag").alias("first_tag"))


def good_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    yes = lambda k: F.when(i % k == 0, "Yes").otherwise("No")
    rows = views.table(spark, sf_dir, "orders").select(i.alias("tag"), F.when(i % 2 == 0, "Python").otherwise("Java").alias("lang"), F.struct(F.when(i % 7 != 0, "Reproducible").alias("status")).alias("reproducibility_status"), F.when(i % 5 != 0, "5/5").otherwise("4/5").alias("stability"), F.struct(yes(4).alias("code"), yes(9).alias("test"), yes(11).alias("build")).alias("classification"), F.struct((i % 3).cast("int").alias("num_of_changed_files")).alias("metrics"))
    return curate.good_entries(rows).select("tag")


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of runs made of orders."""
    i = F.col("ordinal")
    step = lambda name, conclusion: F.struct(name.alias("name"), conclusion.alias("conclusion"))
    steps = F.array(step(F.lit("Lint"), F.when(i % 4 == 0, "failure").otherwise("success")), step(F.coalesce(F.get("failed_steps", F.lit(0)), F.lit("none")), F.when(F.size("failed_steps") > 0, "failure").otherwise("skipped")))
    runs = views.candidates(spark, sf_dir).select("repo", i.alias("run_id"), F.col("attempt").alias("run_attempt"), F.lit("sha").alias("head_sha"), F.lit("ci").alias("workflow_name"), F.lit("u").alias("html_url"), "conclusion", "rerun_passed", F.struct(F.lit("build").alias("name"), steps.alias("steps")).alias("job"))
    return curate.candidates(runs).select("repo", "run_id", "failed_job", "failed_step", "signal")


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that servers ask to wait, by header or body, and what a model may answer."""
    i = F.col("p_partkey")
    header = F.when(i % 4 == 0, F.concat((i % 200).cast("string"), F.lit("s"))).when(i % 4 == 1, "-3").when(i % 8 == 2, "soon")
    body = F.concat(F.lit('{"retryDelay": "'), (i % 50).cast("string"), F.lit('.5s"}'))
    model = F.element_at(F.array(*[F.lit(m.name) for m in registry.MODELS], F.lit("unlisted")), (i % (len(registry.MODELS) + 1) + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", tx.server_wait_seconds(header, body).alias("seconds"), usage.output_token_budget(model).alias("budget"))


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of jobs out of run archives, names with signs that archives change and names that they cut included."""
    found = archives.job_logs(views.archives(spark, sf_dir), views.wanted_jobs(spark, sf_dir))
    return found.select("path", "job", "entry", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "error")


def step_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of the first, the second and a missing step of each job."""
    wanted = views.wanted_jobs(spark, sf_dir).select("path", "job", F.explode(F.array(F.lit(1), F.lit(2), F.lit(12))).alias("step"))
    found = archives.step_logs(views.archives(spark, sf_dir), wanted)
    return found.select("path", "job", "step", "entry", F.md5("text").alias("text_md5"))


def recorded_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily use out of a store that got every batch of requests twice, and folded the first two into one."""
    store = UsageStore(spark, new_path(spark, "usage"))
    rows = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor("value").cast("long").alias("output_tokens"))
    rows = rows.withColumn("input_tokens", F.col("output_tokens") * 10)
    for again in range(2):
        for number in range(3):
            store.record(rows.where(F.col("event_id") % 3 == number), number)
        if not again:
            store.compact(1)
    return store.totals()


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to requests, five of one user's events in a row to each request."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    body = F.when(k % 3 == 0, "RESOURCE_EXHAUSTED: requests per minute").when(k % 17 == 0, "you exceeded your current quota per day").otherwise(F.concat(F.lit('{"retryDelay": "'), (k % 9).cast("string"), F.lit('s"}')))
    status = F.when(k % 10 < 4, 429).when(k % 10 < 6, 503).when(k % 10 == 6, None).when(k == 97, 404).otherwise(200)
    request = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.floor(i / 500).cast("string"))
    return views.table(spark, sf_dir, "events").select(request.alias("request_id"), F.lit("m").alias("model"), i.alias("ord"), status.cast("int").alias("status"), F.when(k % 5 == 0, "4").alias("retry_after"), body.alias("body"))


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([("m", 1)], "model string, max_retries int")
    rows = retries.outcomes(retries.schedule(_responses(spark, sf_dir), caps, max_waits=2), "https://host.example/v1?key=k")
    return rows.select("request_id", "outcome", "waits", F.round("total_wait", 6).alias("total_wait"), "requests", "error")


def _verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    confidence = F.when(i % 5 == 0, '"0.5"').when(i % 5 == 1, "1.5").when(i % 5 == 2, '"high"').otherwise("0.25")
    related = F.when(i % 4 == 0, '"yes"').when(i % 4 == 1, "1").when(i % 4 == 2, "false").otherwise("7")
    head = F.concat(F.lit('{"failure_class": "'), F.when(i % 3 == 0, "bug").otherwise("flaky_test"), F.lit('", "subcategory": "randomness", '))
    whole = F.concat(head, F.when(i % 7 == 0, "").otherwise(F.concat(F.lit('"confidence": '), confidence, F.lit(", "))), F.lit('"related_to_diff": '), related, F.lit(', "evidence": ['), F.when(i % 11 == 0, "3").otherwise('"a"'), F.lit('], "more": {}}'))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.when(i % 13 == 0, F.concat(F.lit("I think: "), F.left(whole, F.lit(40)))).otherwise(whole).alias("text"))


def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers_fn.checked(_verdict_texts(spark, sf_dir), "text")
    c = F.col("checked")
    return rows.select("p_partkey", c["valid"].alias("valid"), c["value"]["confidence"].alias("confidence"), c["value"]["related_to_diff"].alias("related_to_diff"), F.array_join(c["value"]["evidence"], "|").alias("evidence"), answers_fn.error_text(c["errors"]).alias("errors"))


def settled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts to a request, of which the first two answers count at most."""
    i = F.col("p_partkey")
    rows = _verdict_texts(spark, sf_dir).select(F.floor(i / 5).alias("request_id"), i.alias("attempt"), "text", (i % 100).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    settled = answers_fn.settled(rows)
    return settled.select("request_id", F.col("value").isNotNull().alias("answered"), "repaired", "n_answers", "input_tokens", "output_tokens")


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("case_id")
    rows = views.case_results(spark, sf_dir).select("case_id", F.when(i % 29 == 0, "bug").otherwise(F.col("truth_class")).alias("truth_class"), "predicted_class", F.when(i % 31 == 0, True).otherwise(F.col("correct")).alias("correct"), F.when(i % 2 == 0, "late").alias("error"))
    return expectations.evaluate(rows, expectations.RESULT_RULES, "case_id", samples=3).select("rule", "n_rows", "n_broken", F.array_join("offenders", "|").alias("offenders"))


def totals_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's cases and hits, and the totals that the same scan took."""
    i = F.col("case_id")
    rows = views.case_results(spark, sf_dir).withColumns({"input_tokens": i % 1000, "output_tokens": i % 7, "repaired": i % 9 == 0, "failed": F.col("predicted_class").isNull(), "latency_ms": F.lit(2.0)})
    seen_rows, seen = run_totals.observed(rows)
    return run_totals.with_totals(seen_rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct")), seen)


def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with doubled braces, and values that hold braces themselves; one template lacks a value."""
    i, name = F.col("p_partkey"), F.concat(F.lit("{type} }} "), "p_name")
    body = F.when(i % 3 == 0, "Part {name} of {{type}}: {type}\n{name}").when(i % 3 == 1, "{{{type}}}").otherwise("{name}{missing}")
    error = provider.template_error(body, ["name", "type"])
    good = F.when(error.isNull(), body).otherwise("none")
    text = provider.rendered_prompt(good, {"name": name, "type": F.col("p_type")})
    return views.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), error.alias("error"), F.array_join(provider.placeholders(body), ",").alias("wanted"))


def gate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps two cards from being compared: another model and data set, and a report that is lost."""
    card = lambda model, subset, data: scoring.headline(views.case_results(spark, sf_dir)).select(F.lit(model).alias("model"), F.lit(subset).alias("subset"), (F.col("n_cases") + data).cast("string").alias("dataset_hash"), "macro_f1", F.when(F.lit(data) == 0, F.col("accuracy")).alias("hit_at_1"))
    return compare.problem_lines(compare.problems(card("a", "all", 0), card("b", "all", 1)))


def numbered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the agreed cases in the order of their slugs; evidence is stored for some only."""
    stored = views.case_results(spark, sf_dir).where("case_id % 37 <> 0").select(F.format_string("case-%07d", "case_id").alias("slug"))
    rows = curate.reconcile(views.annotations(spark, sf_dir), stored, root="mined")
    ids = curate.case_ids(rows.where("agreed").select("slug"), "gm", 500).select("slug", "case_id", F.lit("").alias("review"))
    return ids.unionByName(rows.where(F.contains("review", F.lit("evidence"))).select("slug", F.lit(None).cast("string").alias("case_id"), "review"))


def _stored_cases(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Cases made of the rows of a table with a whole number as its key."""
    table, key = {"orders": ("orders", "o_orderkey"), "supplier": ("supplier", "s_suppkey")}[name]
    i = F.col(key)
    text = lambda s: F.concat(F.lit(s), i.cast("string"))
    inputs = F.struct(text("org/r").alias("repo"), (i + 31063661240).alias("run_id"), F.array(F.lit("logs/failed_job.txt")).alias("log_files"))
    truth = F.struct(F.when(i % 3 == 0, "flaky_test").otherwise("code_change").alias("failure_class"), F.lit("x").alias("subcategory"), (i % 2 == 0).alias("related_to_diff"))
    origin = F.struct(F.lit("synthetic").alias("source"), (i % 7 == 0).alias("verified_by_human"), F.when(i % 4 == 0, text("note ")).alias("notes"), (i % 3).cast("int").alias("independent_adjudications"))
    made = F.to_json(F.struct(text("c-").alias("case_id"), text("é \" ").alias("title"), inputs.alias("inputs"), truth.alias("ground_truth"), origin.alias("provenance"), F.when(i % 5 == 0, F.array(F.lit("smoke"))).alias("tags")))
    return views.table(spark, sf_dir, table).select(F.from_json(made, cases.CASE).alias("c")).select("c.*")


def merged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases after decisions on a quarter of them were merged in, twice."""
    path = new_path(spark, "cases")
    case_table.store(_stored_cases(spark, sf_dir, "orders"), path, 16)
    i = F.col("o_orderkey")
    told = views.table(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(F.concat(F.lit("c-"), i.cast("string")).alias("case_id"), F.when(i % 8 == 1, "infra_environment").alias("failure_class"), F.lit(None).cast("string").alias("subcategory"), F.lit(None).cast("boolean").alias("related_to_diff"), F.when(i % 3 != 0, 2).alias("adjudicators"), F.when(i % 3 != 0, (i % 3).cast("int")).alias("agreeing"), (i % 16 == 5).alias("human"), F.lit(None).cast("date").alias("verified_date"), F.lit("seen").alias("note"))
    for _ in range(2):
        case_table.merge(spark, path, told, 16)
    p = F.col("provenance")
    return case_table.stored(spark, path).select("case_id", "ground_truth.failure_class", p["verified_by_human"].alias("human"), p["independent_adjudications"].alias("asked"), p["adjudicators_agreeing"].alias("agreed"), p["notes"].alias("notes"), F.array_join("tags", ",").alias("tags"))


def written_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of suppliers written as folders with their logs, and read from there."""
    path = new_path(spark, "case-folders")
    made = _stored_cases(spark, sf_dir, "supplier")
    logs = views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("c-"), F.col("s_suppkey").cast("string")).alias("case_id"), F.lit("logs/failed_job.txt").alias("name"), F.concat(F.lit("log of "), "s_name", F.lit("\r\nend")).alias("text"))
    case_folders.write_folders(case_folders.folder_rows(made, logs), path)
    back = cases.load_cases(spark, path)
    read = cases.case_logs(back, cases.text_files(spark, path, "*.txt"))
    return back.join(read, "case_id").select("case_id", "title", "inputs.run_id", "ground_truth.failure_class", "ground_truth.related_to_diff", "provenance.notes", F.array_join("tags", ",").alias("tags"), "log")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "l_condense_excerpts": condense_excerpts, "l_condense_small_budget": condense_small, "l_condense_logs": condense_logs, "c_clean_lines": clean_lines,
    "k_regex_rules": regex_rules, "k_majority": majority, "k_signals": signals,
    "a_confusion": confusion, "a_class_metrics": class_metrics, "a_headline": headline, "a_answer_rates": answer_rates, "a_dataset_counts": dataset_counts,
    "o_localization": localization, "o_first_hits": first_hits, "f_funnel": funnel, "f_funnel_stages": funnel_stages,
    "g_gate": gate, "g_flips": flips, "m_ranking": model_ranking, "m_winners": model_winners, "t_spreads": trial_spreads,
    "d_diversified": diversified, "d_selected": selected, "d_reconciled": reconciled, "d_failed_jobs": failed_jobs, "h_content_hash": content_hash, "h_row_digests": row_digests,
    "h_bucketed_hash": bucketed_hash, "d_existing": existing, "d_good_entries": good_entries, "d_mined": mined,
    "p_log_ranges": log_ranges, "p_search_reports": search_reports, "p_texts": patch_texts, "p_resolved_paths": resolved_paths, "p_prompt_texts": prompt_texts, "j_answers": answers,
    "k_skip_reasons": skip_reasons, "f_controls": controls, "f_cases": funnel_cases, "a_scorecards": cards, "g_verdict": gate_verdict, "m_notes": model_notes, "u_waits": waits,
    "p_secrets": secrets, "p_patch_policy": patch_policy, "p_search_log": searched, "p_repaired": repaired_patches, "p_edited": edited_patches, "j_redacted_urls": url_forms, "j_run_urls": run_urls,
    "s_job_logs": job_logs, "s_step_logs": step_logs, "u_recorded": recorded_usage, "u_retries": request_outcomes, "u_run_totals": totals_of_a_run,
    "j_checked": checked_answers, "j_settled": settled_answers, "k_broken_rules": broken_rules, "p_rendered": rendered_templates, "g_problems": gate_problems, "d_case_ids": numbered_cases,
    "d_merged": merged_decisions, "s_case_folders": written_folders,
    "u_model_costs": model_costs, "u_daily": daily_usage, "u_preflight": preflight, "u_token_bucket": token_buckets,
}
QUERIES |= outside.QUERIES
