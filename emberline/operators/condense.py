"""Log condensation: error windows within a character budget, or the tail.

condense() takes whole logs, one row each, and shuffles nothing; condense_lines() takes lines, however many a log has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import bound, clean_log, line_groups, split_lines

_EXCERPT = "struct<start_line:int,end_line:int,reason:string,text:string>"


def matches(lines: Column) -> Column:
    """array<struct<n, groups>> of the lines that match a pattern group."""
    found = F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), line_groups(line).alias("groups")))
    return F.filter(found, lambda m: F.size(m["groups"]) > 0)


def windows(found: Column, total: Column, context: int = registry.CONTEXT_LINES) -> Column:
    """array<struct<s, e, groups>>: lines around matches; windows that overlap or touch are one, with the union of groups."""
    apart = lambda f, m, i: (i == 0) | (m["n"] - F.get(f, i - 1)["n"] > 2 * context + 1)

    def window(f: Column, begin: Column, end: Column) -> Column:
        groups = F.array_distinct(F.flatten(F.transform(F.slice(f, begin + 1, end - begin), lambda m: m["groups"])))
        return F.struct(F.greatest(F.lit(1), F.get(f, begin)["n"] - context).alias("s"), F.least(total, F.get(f, end - 1)["n"] + context).alias("e"), groups.alias("groups"))

    # Places at which a window begins: each is as far as the next one, so no window is copied while others are found.
    begins = lambda f: F.filter(F.transform(f, lambda m, i: F.when(apart(f, m, i), i)), lambda i: i.isNotNull())
    spans = lambda f, b: F.transform(b, lambda begin, k: window(f, begin, F.coalesce(F.get(b, k + 1), F.size(f))))
    return bound(found, lambda f: bound(begins(f), lambda b: spans(f, b)))


def excerpts(spans: Column, lines: Column) -> Column:
    names = F.array(*[F.lit(name) for name, _ in registry.PATTERN_GROUPS])

    def excerpt(w: Column) -> Column:
        reason = F.array_join(F.transform(F.array_sort(w["groups"]), lambda g: F.element_at(names, g + 1)), ",")
        text = F.array_join(F.slice(lines, w["s"], w["e"] - w["s"] + 1), "\n")
        return F.struct(w["s"].alias("start_line"), w["e"].alias("end_line"), reason.alias("reason"), text.alias("text"))

    return F.transform(spans, excerpt)


def rendered(excerpt: Column) -> Column:
    return F.concat(F.lit("[lines "), excerpt["start_line"].cast("string"), F.lit("-"), excerpt["end_line"].cast("string"), F.lit(", "), excerpt["reason"], F.lit("]\n"), excerpt["text"])


def longest_fitting_suffix(found: Column, max_chars: int) -> Column:
    """The last excerpts that fit together, two characters apart; the first that doesn't ends it."""
    kind = f"struct<used:int,open:boolean,kept:array<{_EXCERPT}>>"
    begin = F.struct(F.lit(-2).alias("used"), F.lit(True).alias("open"), F.array().cast(f"array<{_EXCERPT}>").alias("kept")).cast(kind)

    def add(acc: Column, e: Column) -> Column:
        used = acc["used"] + 2 + F.length(rendered(e))
        fits = acc["open"] & (used <= max_chars)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), fits.alias("open"), F.when(fits, F.concat(F.array(e), acc["kept"])).otherwise(acc["kept"]).alias("kept")).cast(kind)

    return F.aggregate(F.reverse(found), begin, add, lambda acc: acc["kept"])


def tail(lines: Column, max_chars: int, count: int = registry.TAIL_LINES) -> Column:
    """The last lines as one excerpt, fewer if they don't fit; of a single line that is too long, its end after a marker."""
    total = F.size(lines)
    kind = "struct<start:int,chars:int,open:boolean>"
    header = lambda n: F.length(F.concat(F.lit("[lines "), n.cast("string"), F.lit("-"), total.cast("string"), F.lit(", tail]\n")))

    def add(acc: Column, n: Column) -> Column:
        chars = acc["chars"] + 1 + F.length(F.element_at(lines, n))
        fits = acc["open"] & ((n == total) | (header(n) + chars <= max_chars))
        return F.struct(F.when(fits, n).otherwise(acc["start"]).alias("start"), F.when(fits, chars).otherwise(acc["chars"]).alias("chars"), fits.alias("open")).cast(kind)

    places = F.when(total > 0, F.sequence(total, F.greatest(total - count + 1, F.lit(1)), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.aggregate(places, F.struct(total.alias("start"), F.lit(-1).alias("chars"), F.lit(True).alias("open")).cast(kind), add, lambda acc: acc["start"])
    text = F.array_join(F.slice(lines, start, total - start + 1), "\n")
    over = header(start) + F.length(text) - max_chars
    cut = F.when((start == total) & (over > 0), F.concat(F.lit(registry.TRUNCATED), F.substring(text, over + len(registry.TRUNCATED) + 1, F.length(text)))).otherwise(text)
    excerpt = F.struct(start.alias("start_line"), total.alias("end_line"), F.lit("tail").alias("reason"), cut.alias("text")).cast(_EXCERPT)
    return F.when(total > 0, F.array(excerpt)).otherwise(F.array().cast(f"array<{_EXCERPT}>"))


def condense(logs: DataFrame, *, max_chars: int = registry.MAX_CHARS, text: str = "log", cleaned: bool = False) -> DataFrame:
    """logs with total_lines, strategy (error_windows or tail), excerpts and rendered; the text column itself goes.

    A null log is an empty one: no excerpts, strategy tail.
    """
    if max_chars < registry.MIN_CHARS:
        raise ValueError(f"max_chars is under {registry.MIN_CHARS}")
    log = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(c) for c in logs.columns if c != text]
    # Each step is bound, so that no later one cleans or cuts a log again.
    chosen = lambda lines, kept: F.struct(F.size(lines).alias("total_lines"), F.when(F.size(kept) > 0, "error_windows").otherwise("tail").alias("strategy"), F.when(F.size(kept) > 0, kept).otherwise(tail(lines, max_chars)).alias("excerpts"))
    fitting = lambda lines: longest_fitting_suffix(excerpts(windows(matches(lines), F.size(lines)), lines), max_chars)
    told = bound(split_lines(log if cleaned else clean_log(log)), lambda lines: bound(fitting(lines), lambda kept: chosen(lines, kept)))
    c = "condensed_log"
    return logs.select(*rest, told.alias(c)).select(*rest, f"{c}.total_lines", f"{c}.strategy", f"{c}.excerpts", F.array_join(F.transform(f"{c}.excerpts", rendered), "\n\n").alias("rendered"))


def excerpt_rows(condensed: DataFrame) -> DataFrame:
    rest = [c for c in condensed.columns if c not in ("excerpts", "rendered")]
    return condensed.select(*rest, F.posexplode("excerpts").alias("ordinal", "excerpt")).select(*rest, "ordinal", "excerpt.*")


def condense_lines(lines: DataFrame, *, max_chars: int = registry.MAX_CHARS, key: str = "log_id", context: int = registry.CONTEXT_LINES, count: int = registry.TAIL_LINES) -> DataFrame:
    """(key, total_lines, strategy, start_line, end_line, reason, text): condense()'s excerpts of lines(key, n from 1 on, line), cleaned.

    Windows are gaps and islands over the numbers of the lines that match; what they would take is summed from lengths, and
    text is gathered for those windows and tails only that are kept. So no row holds more than max_chars of a log (or one line). A
    log without lines has no row.
    """
    if max_chars < registry.MIN_CHARS:
        raise ValueError(f"max_chars is under {registry.MIN_CHARS}")
    mask = F.lit(0)
    for i, (_, patterns) in enumerate(registry.PATTERN_GROUPS):
        mask = mask + F.when(F.col("line").rlike("(?U)(?:" + "|".join(patterns) + ")"), 1 << i).otherwise(0)
    numbers = lines.select(key, "n", F.length("line").alias("chars"))
    totals = numbers.groupBy(key).agg(F.max("n").cast("int").alias("total_lines"))
    by_line = Window.partitionBy(key).orderBy("n")
    hits = lines.select(key, "n", mask.alias("mask")).where("mask > 0")
    hits = hits.withColumn("new", F.coalesce(F.col("n") - F.lag("n").over(by_line) > 2 * context + 1, F.lit(True)))
    hits = hits.withColumn("island", F.count_if("new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = hits.groupBy(key, "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.bit_or("mask").alias("mask")).join(totals, key)
    names = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, name) for i, (name, _) in enumerate(registry.PATTERN_GROUPS)]))
    spans = spans.select(key, "island", "total_lines", F.greatest(F.lit(1), F.col("first") - context).cast("int").alias("start_line"), F.least("total_lines", F.col("last") + context).cast("int").alias("end_line"), F.array_join(names, ",").alias("reason"))
    head = F.concat(F.lit("[lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(", "), F.col("reason"), F.lit("]\n"))
    within = lambda s: s.select(key, "island", F.explode(F.sequence("start_line", "end_line")).alias("n"))
    sized = within(spans).join(numbers, [key, "n"]).groupBy(key, "island").agg((F.sum(F.col("chars") + 1) - 1).alias("chars"))
    from_last = Window.partitionBy(key).orderBy(F.desc("island")).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(head) + F.col("chars") + 2).over(from_last) - 2
    kept = spans.join(sized, [key, "island"]).withColumn("used", used).where(F.col("used") <= max_chars).drop("used", "chars")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    texts = within(kept).join(lines.select(key, "n", "line"), [key, "n"]).groupBy(key, "island").agg(joined.alias("text"))
    windows_ = kept.join(texts, [key, "island"]).select(key, "total_lines", F.lit("error_windows").alias("strategy"), "start_line", "end_line", "reason", "text")

    rest = totals.join(kept.select(key).distinct(), key, "left_anti")
    ends = numbers.join(rest, key).where(F.col("n") > F.col("total_lines") - count)
    upto = F.sum(F.col("chars") + 1).over(Window.partitionBy(key).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - 1
    over = F.length(F.concat(F.lit("[lines "), F.col("n").cast("string"), F.lit("-"), F.col("total_lines").cast("string"), F.lit(", tail]\n"))) + upto - max_chars
    starts = ends.withColumn("over", over).where((F.col("n") == F.col("total_lines")) | (F.col("over") <= 0))
    starts = starts.groupBy(key, "total_lines").agg(F.min("n").alias("start"), F.max_by("over", -F.col("n")).alias("over"))
    last = lines.select(key, "n", "line").join(starts, key).where("n >= start").groupBy(key, "total_lines", "start", "over").agg(joined.alias("text"))
    cut = F.when(F.col("over") > 0, F.concat(F.lit(registry.TRUNCATED), F.substring(F.col("text"), F.col("over").cast("int") + len(registry.TRUNCATED) + 1, F.length("text")))).otherwise(F.col("text"))
    tails = last.select(key, "total_lines", F.lit("tail").alias("strategy"), F.col("start").cast("int").alias("start_line"), F.col("total_lines").alias("end_line"), F.lit("tail").alias("reason"), cut.alias("text"))
    return windows_.unionByName(tails)
