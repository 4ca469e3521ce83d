import random
import re

import pytest
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import clean_log, split_lines
from emberline.operators.condense import condense, condense_lines

GROUPS = [(name, [re.compile(p) for p in patterns]) for name, patterns in registry.PATTERN_GROUPS]


def plain(log, budget):
    """(strategy, total, [(start, end, reason, text)]) line by line."""
    lines = log.split("\n") if log else []
    if lines and lines[-1] == "":
        lines.pop()
    total, spans = len(lines), []
    for n, line in enumerate(lines, 1):
        groups = {i for i, (_, ps) in enumerate(GROUPS) if any(p.search(line) for p in ps)}
        if groups:
            s, e = max(1, n - 20), min(total, n + 20)
            if spans and s <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], e, spans[-1][2] | groups)
            else:
                spans.append((s, e, groups))
    show = lambda x: f"[lines {x[0]}-{x[1]}, {x[2]}]\n{x[3]}"
    found = [(s, e, ",".join(GROUPS[g][0] for g in sorted(gs)), "\n".join(lines[s - 1 : e])) for s, e, gs in spans]
    kept, used = [], -2
    for x in reversed(found):
        if used + 2 + len(show(x)) > budget:
            break
        used += 2 + len(show(x))
        kept.insert(0, x)
    if kept:
        return "error_windows", total, kept
    if not lines:
        return "tail", 0, []
    start = max(1, total - 199)
    while start < total and len(show((start, total, "tail", "\n".join(lines[start - 1 :])))) > budget:
        start += 1
    text = "\n".join(lines[start - 1 :])
    over = len(show((start, total, "tail", text))) - budget
    if over > 0:
        text = registry.TRUNCATED + text[over + len(registry.TRUNCATED) :]
    return "tail", total, [(start, total, "tail", text)]


def run(spark, logs, budget):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "id int, log string")
    out = condense(rows, max_chars=budget, cleaned=True).orderBy("id").collect()
    return [(r.strategy, r.total_lines, [tuple(e) for e in r.excerpts]) for r in out]


def run_lines(spark, logs, budget):
    cut = [(i, x.split("\n")) for i, x in enumerate(logs)]
    lines = [(i, n, line) for i, own in cut for n, line in enumerate(own[:-1] if own[-1] == "" else own, 1)]
    out = condense_lines(spark.createDataFrame(lines, "log_id int, n int, line string"), max_chars=budget).orderBy("log_id", "start_line").collect()
    found = {}
    for r in out:
        found.setdefault(r.log_id, (r.strategy, r.total_lines, []))[2].append((r.start_line, r.end_line, r.reason, r.text))
    return [found.get(i, ("tail", 0, [])) for i in range(len(logs))]


@pytest.mark.parametrize("budget", [200, 700, 3000, 24000])
def test_random_logs(spark, budget):
    rng = random.Random(budget)
    hits = ["FAILED tests/a.py", "Traceback (most recent call last)", "x: error: y", "npm ERR! 404", "##[error] z", "Killed", "éKilled", "timed out", "E   assert", "Enot", "error[E1]: q", "AssertionError npm ERR!"]
    logs = ["", "\n", "one", "x" * 5000, "a\n\n"]
    for _ in range(25):
        lines = [rng.choice(hits) if rng.random() < rng.choice([0.0, 0.01, 0.2]) else rng.choice(["", "ok é", "step 12 done", "y" * rng.randint(0, 90)]) for _ in range(rng.randint(1, 400))]
        logs.append("\n".join(lines) + rng.choice(["", "\n"]))
    assert run(spark, logs, budget) == [plain(x, budget) for x in logs]
    assert run_lines(spark, logs, budget) == [plain(x, budget) for x in logs]


def test_literal_spans(spark):
    filler = [f"line {i}" for i in range(1, 201)]
    one = filler[:100]
    one[39], one[49] = "FAILED tests/x.py", "npm ERR! y"
    two = filler[:]
    two[9], two[149] = "MemoryError", "Killed"
    out = run(spark, ["\n".join(one), "\n".join(two)], 24000)
    assert [(e[0], e[1], e[2]) for e in out[0][2]] == [(20, 70, "pytest,dependency")]
    assert [(e[0], e[1], e[2]) for e in out[1][2]] == [(1, 30, "oom_disk"), (130, 170, "oom_disk")]


def test_budget_under_the_least_is_refused(spark):
    with pytest.raises(ValueError):
        condense(spark.createDataFrame([("x",)], "log string"), max_chars=199)


def test_cleaning(spark):
    raw = "﻿2026-01-01T00:00:00.123Z first\r\n2026-01-01T00:00:00Z \x1b[31mred\x1b[0m\rlone 2026-01-01T00:00:00Z kept\n\x1b]8;;u\x07link\x1b]8;;\x07"
    got = spark.createDataFrame([(raw,)], "t string").select(clean_log(F.col("t")).alias("c"), split_lines(F.col("t")).alias("l")).first()
    assert got.c == "first\nred\nlone 2026-01-01T00:00:00Z kept\nlink"


def test_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, log string")
    assert "Exchange" not in condense(rows)._jdf.queryExecution().executedPlan().toString()
