"""What is computed once a row, and how work grows."""

from pyspark.sql import functions as F

from emberline.operators import condense
from emberline.operators import patches as px


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_artifact_cuts_its_output_once(spark):
    rows = spark.range(1).select(px.artifact(F.lit("a-1"), F.col("id").cast("string")).alias("a")).select("a.slug", "a.failing_log", "a.fix_diff", "a.culprit_files", "a.error")
    assert optimized(rows).count("split(") <= 12  # sections, words of the layout, and lines


def test_a_corrupted_patch_is_cut_once(spark):
    p = F.col("id").cast("string")
    assert optimized(spark.range(1).select(px.corrupted(p).alias("x"))).count("split(") == 1


def test_a_checked_patch_is_cut_once(spark):
    p = F.col("id").cast("string")
    assert optimized(spark.range(1).select(px.check_patch(p, F.lit("x")).alias("x"))).count("split(") == 1


def test_a_log_is_cleaned_and_cut_once(spark):
    rows = condense.condense(spark.range(1).select(F.col("id").cast("string").alias("log")))
    assert optimized(rows).count("split(") == 1


def test_windows_are_not_copied_for_each_match(spark):
    found = condense.matches(F.split(F.col("id").cast("string"), ","))
    assert optimized(spark.range(1).select(condense.windows(found, F.lit(5)).alias("x"))).count("aggregate(") == 0
