"""URL filters: host and path rules, longest first, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import Scratch, written
from emberline.llm.graph import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 200
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Features a tree may split on, in the order of the vector.
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "fragment", "dots_in_path", "plain_http", "suffix_log_count", "suffix_block_rate", "suffix_path_log_count", "suffix_path_block_rate", "first_label_log_count", "first_label_block_rate"]


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block' for a host, its subdomains and paths from path on; written like `example.com/en/`."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end. Else empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), UPPER, LOWER), F.regexp_extract(text, _PARTS, 2)


def with_rules(rows: DataFrame, rules: list[Rule], inline: int = INLINE_RULES) -> DataFrame:
    """rows(host, path, ...) with rule, the text of the longest rule that fits, else null.

    Up to `inline` rules are one expression. More of them are a table by host, which the last labels of a page's host look up:
    one join for each number of labels that rules have, with the rules on the side that is broadcast.
    """
    host, path = F.col("host"), F.col("path")
    if len(rules) <= inline:
        found = F.lit(None).cast("string")
        for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
            fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
            found = F.when(fits, F.lit(r.text)).otherwise(found)
        return rows.withColumn("rule", found)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append((r.path, r.text))
    told = []
    for k in sorted({h.count(".") + 1 for h in by_host}):
        own = [(h, paths) for h, paths in by_host.items() if h.count(".") + 1 == k]
        side = rows.sparkSession.createDataFrame(own, f"rule_host_{k} string, rules_{k} array<struct<path: string, text: string>>")
        rows = rows.join(F.broadcast(side), F.substring_index(host, ".", -k) == F.col(f"rule_host_{k}"), "left").drop(f"rule_host_{k}")
        told.append(F.coalesce(F.col(f"rules_{k}"), F.array().cast("array<struct<path: string, text: string>>")))
    fitting = F.filter(F.concat(*told), lambda r: F.startswith(path, r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["text"]).alias("n"), r["text"].alias("text"))))
    return rows.withColumn("rule", longest["text"]).drop(*[c for c in rows.columns if c.startswith("rules_")])


def entropy(text: Column) -> Column:
    """Bits a character, by the character's share of the text; 0 for an empty one."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, -F.aggregate(letters, F.lit(0.0), lambda total, c: total + share(c) * F.log2(share(c)))).otherwise(0.0)


def with_features(pages: DataFrame) -> DataFrame:
    """pages with the lexical features of url, host and path, and the keys its suffix statistics go by."""
    url = F.coalesce("url", F.lit(""))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    host, path = F.col("host"), F.col("path")
    columns = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": count(path, "/"), "labels": count(host, ".") + 1,
        "digit_ratio": digits(url), "host_digit_ratio": digits(host), "hyphens": count(host, "-"), "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0), "fragment": F.contains(url, F.lit("#")).cast("int"), "dots_in_path": count(path, "."), "plain_http": F.startswith(F.translate(url, UPPER, LOWER), F.lit("http://")).cast("int"),
    }
    out = pages.withColumns({k: v.cast("double") for k, v in columns.items()})
    suffix = F.substring_index(host, ".", -1)
    return out.withColumns({"suffix_key": suffix, "suffix_path_key": F.concat(suffix, F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2))), "first_label_key": F.concat_ws(".", F.split_part(host, F.lit("."), F.lit(1)), F.substring_index(host, ".", -2))})


def with_suffix_statistics(rows: DataFrame, scratch: Scratch, smoothing: float = 20.0) -> DataFrame:
    """rows with, for each key, the log of its count over all rows and its smoothed share of blocked ones among labelled rows.

    Labelled URLs are in one of two folds by hash, copies of one URL in the same; a labelled row gets the share in the other fold,
    so that no row is told its own label. Counts are summed before they are shuffled, written once, and go back by a broadcast
    up to a checked size, beyond it by a join that Spark splits where a key is hot.
    """
    for name in ("suffix", "suffix_path", "first_label"):
        counts = [F.count(F.when(F.col("fold") == k, F.col("label"))).alias(f"told_{k}") for k in (0, 1)]
        counts += [F.sum(F.when((F.col("fold") == k) & (F.col("label") == 1), 1).otherwise(0)).alias(f"blocked_{k}") for k in (0, 1)]
        stats = rows.groupBy(f"{name}_key").agg(F.log1p(F.count("*").cast("double")).alias(f"{name}_log_count"), *counts)
        rows = rows.join(small(scratch.written(stats, "url-statistics")), f"{name}_key")
        unseen = lambda c: F.when(F.col("label").isNull(), F.col(f"{c}_0") + F.col(f"{c}_1")).when(F.col("fold") == 0, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
        rows = rows.withColumn(f"{name}_block_rate", (unseen("blocked") + smoothing / 2) / (unseen("told") + smoothing)).drop("told_0", "told_1", "blocked_0", "blocked_1")
    return rows


def judge_urls(pages: DataFrame, rules: list[Rule], *, labels: DataFrame | None = None, max_train_rows: int = 20_000, trees: int = 20, depth: int = 4, learning_rate: float = 0.2, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages(page_id, url).

    verdict is the longest fitting rule's; else that of gradient-boosted trees, and score is their likelihood of `block` (null
    under a rule). The trees learn from labelled URLs: labels(url, label 1 for block) if given, else the URLs that rules
    decide. At most max_train_rows of them, by hash of url, are used; suffix statistics count all rows. With labels of one
    kind only, that kind is the verdict; with none, allow. Null and malformed URLs have an empty host and path. Features are
    made once and written.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scratch = Scratch()
    host, path = url_parts()
    rows = with_rules(pages.select("page_id", "url").withColumns({"host": host, "path": path}), rules)
    blocked = [r.text for r in rules if r.verdict == "block"]
    verdicts = rows.sparkSession.createDataFrame([(r.text, int(r.verdict == "block")) for r in rules], "rule string, rule_label int").distinct()
    if len(blocked) > INLINE_RULES:
        rows = rows.join(F.broadcast(verdicts), "rule", "left")
    else:
        by_rule = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), 1).otherwise(0)) if blocked else F.when(F.col("rule").isNotNull(), 0)
        rows = rows.withColumn("rule_label", by_rule)
    if labels is None:
        rows = rows.withColumn("label", F.col("rule_label"))
    else:
        told = labels.where("label IN (0, 1)").groupBy("url").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("url", "label")
        rows = rows.join(small(written(told, "url-labels")), "url", "left")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(2))).withColumn("place", F.xxhash64("url", "page_id"))
    features = written(with_features(rows).drop("url"), "url-features")
    rows = with_suffix_statistics(features, scratch)
    train = rows.where("label IS NOT NULL").orderBy("place", "page_id", "host", "path").limit(max_train_rows).select(F.col("label").cast("double").alias("label"), *FEATURES)
    train = scratch.written(train, "url-training")
    kinds = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    known = F.when(F.col("rule_label") == 1, "block").when(F.col("rule_label") == 0, "allow")
    if len(kinds) < 2:
        only = "block" if 1.0 in kinds else "allow"
        scratch.clear()
        return features.select("page_id", "host", "path", "rule", F.coalesce(known, F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    booster = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=learning_rate, seed=seed, maxBins=32, cacheNodeIds=False)
    model = booster.fit(assemble.transform(train).select("features", "label"))
    scored = model.transform(assemble.transform(rows)).withColumn("likelihood", vector_to_array("probability")[1])
    method = F.when(F.col("likelihood") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(known, method).alias("verdict"), F.when(F.col("rule").isNull(), F.col("likelihood")).alias("score"))
