"""Comparing runs: the regression gate, ranking of models, spread over trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import registry


def metric_rows(cards: DataFrame, key: list[str]) -> DataFrame:
    """(key, ord, metric, value): one row for each metric that a card has; a null one is absent."""
    pairs = ", ".join(f"{i}, '{m}', CAST({m} AS DOUBLE)" for i, (m, _, _) in enumerate(registry.METRICS) if m in cards.columns)
    n = sum(m in cards.columns for m, _, _ in registry.METRICS)
    return cards.selectExpr(*key, f"stack({n}, {pairs}) AS (ord, metric, value)").where("value IS NOT NULL")


def gate(baseline: DataFrame, current: DataFrame, tolerances: dict[str, float] | None = None, both_baselines: bool = False) -> DataFrame:
    """(ord, metric, baseline, current, delta, tolerance, regressed) of the metrics that both one-row cards have.

    A metric regresses if it gets worse by more than its tolerance. Two baseline models have no tolerance.
    """
    told = [(m, 0.0 if both_baselines else (tolerances or {}).get(m, t), up) for m, t, up in registry.METRICS]
    dim = F.broadcast(baseline.sparkSession.createDataFrame(told, "metric string, tolerance double, up boolean"))
    a = metric_rows(baseline, []).withColumnRenamed("value", "baseline")
    b = metric_rows(current, []).select("metric", F.col("value").alias("current"))
    delta = F.col("current") - F.col("baseline")
    drift = F.when(F.col("up"), -delta).otherwise(delta)
    return a.join(b, "metric").join(dim, "metric").select("ord", "metric", "baseline", "current", delta.alias("delta"), "tolerance", (drift > F.col("tolerance") + registry.SLACK).alias("regressed"))


#: Identity fields that must be equal, by what they are called; a report, and a metric that only it has.
_IDENTITY = [("model", "model"), ("subset", "subset"), ("dataset_hash", "dataset")]
_REPORTS = [("classification", "macro_f1"), ("localization", "hit_at_1")]


def problems(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, problem) of two one-row cards: changed, with what an identity field was and is, and lost, with a report that only the baseline has.

    Fields and metrics that the baseline lacks as columns aren't looked at; one that only the current card lacks is lost. A prompt may change: its effect is what is compared.
    """
    none = F.lit(None).cast("string")
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("none"))
    pair = baseline.select(F.struct(*baseline.columns).alias("a")).crossJoin(current.select(F.struct(*current.columns).alias("b")))
    told = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("problem"))
    checks: list = []
    for c, name in _IDENTITY:
        if c in baseline.columns and c in current.columns:
            checks.append(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), told("changed", F.concat(F.lit(f"{name} changed: "), text("a", c), F.lit(" to "), text("b", c)))))
    for report, metric in _REPORTS:
        if metric in baseline.columns:
            now = F.col(f"b.{metric}") if metric in current.columns else none
            checks.append(F.when(F.col(f"a.{metric}").isNotNull() & now.isNull(), told("lost", F.lit(report))))
    if not checks:
        return pair.select(none.alias("kind"), none.alias("problem")).where(F.lit(False))
    return pair.select(F.explode(F.array_compact(F.array(*checks))).alias("p")).select("p.*")


def problem_lines(found: DataFrame) -> DataFrame:
    """(ord, line) of problems(): what a report says of reports that were lost, and of fields that keep cards from being compared, in their order."""
    places = [(f"{name} changed", i) for i, (_, name) in enumerate(_IDENTITY)] + [(report, i) for i, (report, _) in enumerate(_REPORTS)]
    place = F.coalesce(*[F.when(F.startswith("problem", F.lit(text)), i) for text, i in places])
    # At most as many rows as there are fields and reports.
    rows = found.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), "problem"))).alias("told"))
    texts = F.transform("told", lambda x: x["problem"])
    line = F.when(F.col("kind") == "lost", F.concat(F.lit("Reports lost since the baseline: "), F.array_join(texts, ", "))).otherwise(F.concat(F.lit("Not comparable: "), F.array_join(texts, "; ")))
    return rows.select(F.when(F.col("kind") == "lost", 0).otherwise(1).alias("ord"), line.alias("line"))


def both_baselines(baseline_model: str, current_model: str) -> bool:
    """Whether both names are of models that replay without noise, so that nothing is forgiven."""
    return {baseline_model, current_model} <= set(registry.BASELINE_MODELS)


def verdict(gated: DataFrame, found: DataFrame) -> DataFrame:
    """One row: regressed, n_regressed, n_problems of gate() and problems(). A regression fails the run that asks."""
    drops = gated.agg(F.count_if("regressed").alias("n_regressed"))
    both = drops.crossJoin(F.broadcast(found.agg(F.count("*").alias("n_problems"))))
    return both.select((F.col("n_regressed") + F.col("n_problems") > 0).alias("regressed"), "n_regressed", "n_problems")


def flips(baseline: DataFrame, current: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, change): cases of both runs that fail or pass newly. An unanswered case is not correct."""
    a, b = baseline.select(key, F.col("correct").alias("was")), current.select(key, F.col("correct").alias("now"))
    both = a.join(b, key).where("was <> now")
    return both.select(key, F.when(F.col("was"), "newly_failing").otherwise("newly_passing").alias("change"))


def ranked(models: DataFrame) -> DataFrame:
    """models(model, ordinal, coverage, macro_f1, ...) with place: by coverage, then macro F1, then ordinal; failed ones last.

    One row a model: the window is over as many rows as there are models.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.desc(F.coalesce("coverage", F.lit(-1.0))), F.desc(F.coalesce("macro_f1", F.lit(-1.0))), "ordinal")
    return models.withColumn("place", F.row_number().over(order))


def winners(models: DataFrame) -> DataFrame:
    """One row: the complete models with the best macro F1, the least cost and the least time; first of equals; nulls if none."""
    complete = models.where("error IS NULL AND coverage >= 1")
    first = lambda metric, sign: F.max_by("model", F.struct(sign * F.col(metric), -F.col("ordinal")))
    return complete.agg(first("macro_f1", 1).alias("best_macro_f1"), first("cost", -1).alias("cheapest"), first("seconds", -1).alias("fastest"), F.count("*").alias("n_complete"))


def notes(models: DataFrame) -> DataFrame:
    """(ord, note) on models(model, ordinal, n_answered, n_cases, error): what a ranking leaves out, the incomplete first."""
    partial = F.col("error").isNull() & (F.col("n_answered") < F.col("n_cases"))
    model = F.concat(F.lit("`"), F.col("model"), F.lit("`"))
    text = F.when(partial, F.concat(model, F.lit(" answered only "), F.col("n_answered").cast("string"), F.lit(" of "), F.col("n_cases").cast("string"), F.lit(" cases. Its scores cover the cases it managed and are not comparable.")))
    text = text.when(F.col("error").isNotNull(), F.concat(model, F.lit(" could not be scored: "), F.col("error")))
    each = models.select(F.when(partial, 1).otherwise(2).alias("kind"), "ordinal", text.alias("note")).where("note IS NOT NULL")
    none = models.agg(F.count_if(F.col("error").isNull() & ~partial).alias("n")).where("n = 0").select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ordinal"), F.lit("No model answered every case, so nothing here is rankable.").alias("note"))
    return none.unionByName(each.withColumn("ordinal", F.col("ordinal").cast("long")))


def spreads(trials: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean, low, high, spread, stdev) over trials that have the metric; the sample deviation, 0 for one trial."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    rows = trials.selectExpr(*by, f"stack({len(metrics)}, {pairs}) AS (metric, value)").where("value IS NOT NULL")
    sums = rows.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))
    return sums.select(*by, "metric", "n", "mean", "low", "high", (F.col("high") - F.col("low")).alias("spread"), "stdev")


def widest(spread_rows: DataFrame, by: list[str]) -> DataFrame:
    return spread_rows.groupBy(*by).agg(F.max_by("metric", F.struct("spread", "metric")).alias("metric"), F.max("spread").alias("spread"))
