"""Benchmark scoring: confusion, classification figures, localization, fix funnel. Aggregates over case rows, tiny dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import normalize_path


def class_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(registry.FAILURE_CLASSES)), "ord int, failure_class string")


def cost_dim(spark: SparkSession) -> DataFrame:
    rows = [(t, p, registry.error_cost(t, p)) for t in registry.FAILURE_CLASSES for p in registry.FAILURE_CLASSES]
    return spark.createDataFrame(rows, "truth_class string, predicted_class string, cost double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def answered(results: DataFrame) -> DataFrame:
    return results.where("predicted_class IS NOT NULL")


def confusion(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, truth_class, predicted_class, n): a row for each of the 16 pairs of classes, zeros too, for each group."""
    by = by or []
    dim = F.broadcast(class_dim(results.sparkSession))
    counts = answered(results).groupBy(*by, "truth_class", "predicted_class").agg(F.count("*").alias("n"))
    cells = dim.select(F.col("failure_class").alias("truth_class"), F.col("ord").alias("truth_ord")).crossJoin(dim.select(F.col("failure_class").alias("predicted_class"), F.col("ord").alias("predicted_ord")))
    if by:
        cells = counts.select(*by).distinct().crossJoin(F.broadcast(cells))
    return cells.join(counts, [*by, "truth_class", "predicted_class"], "left").select(*by, "truth_class", "predicted_class", "truth_ord", "predicted_ord", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, failure_class, ord, support, precision, recall, f1) for all four classes; empty denominators give 0."""
    by = by or []
    cells = confusion(results, by)
    one = cells.select(*by, F.col("truth_class").alias("failure_class"), F.col("truth_ord").alias("ord"), "n", F.lit(0).alias("p"), F.when(F.col("truth_class") == F.col("predicted_class"), F.col("n")).otherwise(0).alias("h"))
    two = cells.select(*by, F.col("predicted_class").alias("failure_class"), F.col("predicted_ord").alias("ord"), F.lit(0).alias("n"), F.col("n").alias("p"), F.lit(0).alias("h"))
    sums = one.unionByName(two).groupBy(*by, "failure_class", "ord").agg(F.sum("n").alias("support"), F.sum("p").alias("told"), F.sum("h").alias("hits"))
    precision, recall = ratio(F.col("hits"), F.col("told")), ratio(F.col("hits"), F.col("support"))
    return sums.select(*by, "failure_class", "ord", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("hits"), F.col("told") + F.col("support")).alias("f1"))


def headline(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_cases, n_answered, coverage, accuracy, macro_f1, cost_weighted_error); macro F1 is over all four classes.

    Without an answered case the figures of classification are null, as there is no report.
    """
    by = by or []
    costs = F.broadcast(cost_dim(results.sparkSession))
    joined = results.join(costs, ["truth_class", "predicted_class"], "left")
    known = F.col("predicted_class").isNotNull()
    base = joined.groupBy(*by).agg(
        F.count("*").alias("n_cases"),
        F.count("predicted_class").alias("n_answered"),
        F.sum((known & (F.col("truth_class") == F.col("predicted_class"))).cast("long")).alias("hits"),
        F.sum("cost").alias("cost"),
    )
    macro = class_metrics(results, by).groupBy(*by).agg((F.sum("f1") / len(registry.FAILURE_CLASSES)).alias("macro"))
    both = base.join(macro, by, "left") if by else base.crossJoin(macro)
    some = F.col("n_answered") > 0
    return both.select(
        *by, "n_cases", "n_answered", ratio(F.col("n_answered"), F.col("n_cases")).alias("coverage"),
        F.when(some, ratio(F.col("hits"), F.col("n_answered"))).alias("accuracy"),
        F.when(some, F.col("macro")).alias("macro_f1"),
        F.when(some, ratio(F.col("cost"), F.col("n_answered"))).alias("cost_weighted_error"),
    )


def binary_metrics(results: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1, n of a boolean, true being positive; rows where either is null are left out."""
    t, p = F.col(truth), F.col(predicted)
    sums = results.where(t.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return sums.select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "n")


def answer_rates(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, subcategory_rate over answered cases, related_rate over answered and scorable ones, related_scored, schema_failure_rate)."""
    known = F.col("predicted_class").isNotNull()
    scorable = known & F.col("related_to_diff_correct").isNotNull()
    sums = results.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), F.count_if(known).alias("a"), F.count_if(known & F.col("subcategory_correct")).alias("s"), F.count_if(scorable).alias("related_scored"), F.count_if(scorable & F.col("related_to_diff_correct")).alias("r")
    )
    return sums.select(*(by or []), ratio(F.col("s"), F.col("a")).alias("subcategory_rate"), ratio(F.col("r"), F.col("related_scored")).alias("related_rate"), "related_scored", ratio(F.col("cases") - F.col("a"), F.col("cases")).alias("schema_failure_rate"))


def rank_of_first_hit(ranked: Column, truth: Column) -> Column:
    """1-based rank of the first ranked path that is a true one, after normalisation; null if none is, or nothing is ranked."""
    wanted = F.transform(truth, normalize_path)
    hits = F.filter(F.transform(ranked, lambda p, i: F.when(F.array_contains(wanted, normalize_path(p)), i + 1)), lambda r: r.isNotNull())
    return F.array_min(hits)


def hit_at(ranked: Column, truth: Column, k: int) -> Column:
    return F.lit(False) if k <= 0 else F.coalesce(rank_of_first_hit(F.slice(ranked, 1, k), truth).isNotNull(), F.lit(False))


def localization(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_evaluated, hit_at_1, hit_at_5, mrr) of cases(truth, ranked arrays).

    Cases without true paths or with a null ranking are no samples; an empty ranking is one that misses.
    """
    samples = cases.where((F.size("truth") > 0) & F.col("ranked").isNotNull()).withColumn("rank", rank_of_first_hit(F.col("ranked"), F.col("truth")))
    sums = samples.groupBy(*(by or [])).agg(F.count("*").alias("n_evaluated"), F.count_if(F.col("rank") <= 1).alias("h1"), F.count_if(F.col("rank") <= 5).alias("h5"), *[F.count_if(F.col("rank") == k).alias(f"r{k}") for k in range(1, 6)], F.sum(F.when(F.col("rank") > 5, 1 / F.col("rank"))).alias("beyond"))
    # hits by rank are counted and divided once, so the sum has one order
    total = F.coalesce("beyond", F.lit(0.0))
    for k in range(5, 0, -1):
        total = total + F.col(f"r{k}") / k
    return sums.select(*(by or []), "n_evaluated", ratio(F.col("h1"), F.col("n_evaluated")).alias("hit_at_1"), ratio(F.col("h5"), F.col("n_evaluated")).alias("hit_at_5"), ratio(total, F.col("n_evaluated")).alias("mrr"))


STAGES = ["applies", "lints", "failing_test_passes", "nothing_else_broke"]


def funnel(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_cases, n_attempted, n_skipped, the cumulative count of each stage among attempted, three rates, on_target).

    A null level is 0: nothing applied. Levels count cumulatively: whoever reached one has passed those before.
    """
    tried, level = F.col("attempted"), F.coalesce("level", F.lit(0))
    sums = attempts.groupBy(*(by or [])).agg(F.count("*").alias("n_cases"), F.count_if(tried).alias("n_attempted"), *[F.count_if(tried & (level >= k)).alias(s) for k, s in enumerate(STAGES, 1)], F.count_if(tried & F.col("localized")).alias("on_target"))
    return sums.select(*(by or []), "n_cases", "n_attempted", (F.col("n_cases") - F.col("n_attempted")).alias("n_skipped"), *STAGES, "on_target", *[ratio(F.col(s), F.col("n_attempted")).alias(r) for s, r in ((STAGES[0], "apply_rate"), (STAGES[2], "fix_rate"), (STAGES[3], "clean_fix_rate"))])


def funnel_rows(report: DataFrame) -> DataFrame:
    """(stage_ord, stage, n, share): the funnel as rows, each with its share of the attempts."""
    pairs = ", ".join(f"{i}, '{s}', {s}" for i, s in enumerate(["n_attempted", *STAGES]))
    return report.selectExpr("n_attempted AS attempts", f"stack({len(STAGES) + 1}, {pairs}) AS (stage_ord, stage, n)").select("stage_ord", "stage", "n", ratio(F.col("n"), F.col("attempts")).alias("share"))


def control(runs: DataFrame) -> DataFrame:
    """(case_id, usable, reason) of runs(case_id, reference_level, corrupted_level): usable if only the true fix gets to the top.

    A null reference level: no fix is stored.
    """
    top = len(STAGES)
    real, broken = F.col("reference_level"), F.coalesce("corrupted_level", F.lit(0))
    names = F.array(*[F.lit(n) for n in registry.LEVELS])
    reason = F.when(real.isNull(), "no reference fix stored").when(real < top, F.concat(F.lit("reference fix only reached "), F.element_at(names, real + 1))).when(broken >= top, "the corrupted fix passed too, so the build proves nothing").otherwise("")
    return runs.select("case_id", F.coalesce((real == top) & (broken < top), F.lit(False)).alias("usable"), reason.alias("reason"))


def ranked_paths(ranked_files: Column) -> Column:
    """The paths of array<struct<path, ...>>, the first five; none of a null ranking."""
    paths = F.transform(F.slice(ranked_files, 1, registry.MAX_RANKED_FILES), lambda f: f["path"])
    return F.coalesce(paths, F.array().cast("array<string>"))


def on_target(ranked: Column, culprits: Column) -> Column:
    """Whether a ranked path is a culprit, spelt alike."""
    return F.coalesce(F.arrays_overlap(F.array_compact(ranked), F.array_compact(culprits)), F.lit(False))


def executable(cases: DataFrame) -> DataFrame:
    """Cases whose patches can be judged by running their image, with image_tag."""
    image = F.col("verification.docker_image")
    kept = cases.where((F.col("verification.method") == "bugswarm_image") & (F.coalesce(image, F.lit("")) != ""))
    return kept.withColumn("image_tag", image_tag(image))


def image_tag(image: Column) -> Column:
    """An image's name without the prefix that all have; empty for a null one."""
    name = F.coalesce(image, F.lit(""))
    return F.when(F.startswith(name, F.lit(registry.IMAGE_PREFIX)), F.substring(name, len(registry.IMAGE_PREFIX) + 1, 1 << 20)).otherwise(name)


def funnel_cases(cases: DataFrame, unmeasurable: DataFrame, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The executable cases that a funnel runs: of `only`, if any are named, without unmeasurable(case_id), the first limit by id."""
    runnable = executable(cases)
    if only:
        runnable = runnable.where(F.col("case_id").isin(only))
    kept = runnable.join(unmeasurable.select("case_id").distinct(), "case_id", "left_anti")
    return kept.orderBy("case_id").limit(limit) if limit else kept


def attempt_error(kind: Column, message: Column) -> Column:
    """skip_reason of a case whose attempt failed: 300 characters at most."""
    return F.left(F.concat(kind, F.lit(": "), message), F.lit(300))


def scorecards(results: DataFrame, identity: list[str], localized: DataFrame | None = None, attempts: DataFrame | None = None) -> DataFrame:
    """One row for each identity (git_sha, model, prompt_hash, dataset_hash, subset): the headline figures of results, and of
    localized(identity, truth, ranked) and attempts(identity, ...) where given. A report without samples is null."""
    out = headline(results, identity)
    for samples, report, names in ((localized, localization, ["hit_at_1", "hit_at_5", "mrr"]), (attempts, funnel, ["n_attempted", "apply_rate", "fix_rate", "clean_fix_rate"])):
        if samples is not None:
            out = out.join(report(samples, identity).select(*identity, *names), identity, "left")
    return out


def funnel_report(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, attempts in the order of case_id with the names of levels): what runs of single cases add up to. ValueError if none."""
    if attempts.isEmpty():
        raise ValueError("no attempts")
    names = F.array(*[F.lit(n) for n in registry.LEVELS])
    named = attempts.withColumn("level", F.when(F.col("attempted"), F.element_at(names, F.coalesce("level", F.lit(0)) + 1)))
    return funnel(attempts), named.orderBy("case_id")
