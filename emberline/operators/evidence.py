"""What is read out of long logs: ranges of lines, and lines with a text. Logs are tables of lines (log_id, n, line), n from 1; none is ever held whole.

A request is joined to the blocks of lines that it can touch, or goes to a log as one of an array of texts that each line is looked at for
once; what is gathered is what a reader is shown, which has a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import strip
from emberline.operators.patches import quoted


def totals(lines: DataFrame) -> DataFrame:
    """(log_id, total): how many lines each log has."""
    return lines.groupBy("log_id").agg(F.count("*").alias("total"))


def ranges(lines: DataFrame, wanted: DataFrame, cap: int = registry.MAX_RANGE_LINES) -> DataFrame:
    """wanted(log_id, ord, first, last) with text: lines first to last, inclusive, at most cap of them, under a header that says so if the cap cut some off.

    A range that starts outside of its log says how many lines there are; a log without lines is one empty line.
    """
    known = wanted.join(totals(lines), "log_id", "left").withColumn("total", F.coalesce("total", F.lit(1)).cast("long"))
    capped = F.least(F.col("last").cast("long"), F.col("first").cast("long") + (cap - 1))
    known = known.withColumns({"stop": F.least(capped, "total"), "cut": capped < F.col("last"), "inside": (F.col("first") >= 1) & (F.col("first") <= F.col("total"))})
    # A range meets at most two blocks of cap lines.
    some = known.where("inside AND stop >= first").select("log_id", "ord", "first", "stop", F.explode(F.sequence(F.floor(F.col("first") / cap), F.floor(F.col("stop") / cap))).alias("block"))
    # Blocks are known by number, so only lines of wanted blocks are shuffled further than the join.
    held = some.join(lines.select("log_id", "n", "line", F.floor(F.col("n") / cap).alias("block")), ["log_id", "block"]).where("n BETWEEN first AND stop")
    body = held.groupBy("log_id", "ord").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("told"))
    body = body.select("log_id", "ord", F.array_join(F.transform("told", lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("[lines "), F.col("first").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.when(F.col("cut"), " (truncated)").otherwise(""), F.lit("]\n"))
    outside = F.concat(F.lit(f"{registry.NOT_FOUND}: the log has lines 1 to "), F.col("total").cast("string"))
    rows = known.join(body, ["log_id", "ord"], "left")
    return rows.select(*wanted.columns, F.when(F.col("inside"), F.concat(head, F.coalesce("body", F.lit("")))).otherwise(outside).alias("text"))


def searches(lines: DataFrame, needles: list[str], limit: int = 20, chars: int = 160) -> DataFrame:
    """(log_id, ord, hits array<struct<n, line>>, more) of every log for each of the needles, ord from 1: the first lines that have the literal text,
    trimmed and cut, and how many more there are.

    Lines without any of the texts go at once. The first `limit` hits of a log are found in each task before they meet.
    """
    places = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(t).alias("needle")) for i, t in enumerate(needles)])
    hits = lines.select("log_id", "n", "line", F.explode(F.filter(places, lambda p: F.contains(F.col("line"), p["needle"]))).alias("p")).select("log_id", F.col("p.ord").alias("ord"), "n", F.left(strip(F.col("line")), F.lit(chars)).alias("line"))
    counts = hits.groupBy("log_id", "ord").agg(F.count("*").alias("k"))
    order = Window.partitionBy("log_id", "ord").orderBy("n")
    first = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    shown = first.groupBy("log_id", "ord").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("hits"))
    every = lines.select("log_id").distinct().select("log_id", F.explode(F.sequence(F.lit(1), F.lit(len(needles)))).alias("ord"))
    rows = every.join(shown, ["log_id", "ord"], "left").join(counts, ["log_id", "ord"], "left")
    none = F.array().cast("array<struct<n:int,line:string>>")
    return rows.select("log_id", "ord", F.coalesce(F.col("hits").cast("array<struct<n:int,line:string>>"), none).alias("hits"), F.greatest(F.coalesce("k", F.lit(0)) - limit, F.lit(0)).alias("more"))


def search_texts(lines: DataFrame, needles: list[str], limit: int = 20) -> DataFrame:
    """(log_id, ord, text): searches() as a reader is shown them: `number: line` for each hit, then how many more; it says so if there are none."""
    shown = F.array_join(F.transform("hits", lambda h: F.concat(h["n"].cast("string"), F.lit(": "), h["line"])), "\n")
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n..."), F.col("more").cast("string"), F.lit(" more matches"))).otherwise("")
    needle = F.element_at(F.array(*[F.lit(t) for t in needles]), F.col("ord"))
    none = F.concat(F.lit(f"{registry.NOT_FOUND}: no line contains "), quoted(needle))
    return searches(lines, needles, limit).select("log_id", "ord", F.when(F.size("hits") > 0, F.concat(shown, more)).otherwise(none).alias("text"))
