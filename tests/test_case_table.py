import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.sources import case_folders as cf
from emberline.sources import case_table as ct
from emberline.sources import cases as src

KIND = src.CASE


def some_cases(spark, n=60):
    i = F.col("id")
    text = lambda s: F.concat(F.lit(s), i.cast("string"))
    none = F.lit(None)
    inputs = F.named_struct(F.lit("repo"), text("r"), F.lit("run_id"), i + 31063661240, F.lit("log_files"), F.array(F.lit("logs/a.txt")))
    truth = F.named_struct(F.lit("failure_class"), F.lit("flaky_test"), F.lit("subcategory"), F.lit("randomness"), F.lit("related_to_diff"), none)
    origin = F.named_struct(F.lit("source"), F.lit("synthetic"), F.lit("verified_by_human"), F.lit(False), F.lit("notes"), F.when(i % 3 == 0, text("note ")), F.lit("independent_adjudications"), F.lit(1), F.lit("adjudicators_agreeing"), F.lit(1))
    rows = spark.range(n).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), text("c-").alias("case_id"), text("t \"é\" ").alias("title"), inputs.alias("inputs"), truth.alias("ground_truth"), origin.alias("provenance"), F.when(i % 2 == 0, F.array(F.lit("x"))).alias("tags"))).alias("j"))
    return rows.select(F.from_json("j", KIND).alias("c")).select("c.*")


def decisions(spark, rows):
    return spark.createDataFrame(rows, ct.DECISION)


def files(path):
    return {f: (os.stat(f).st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def test_a_merge_touches_only_what_it_changes(spark, tmp_path):
    path = str(tmp_path / "cases")
    ct.store(some_cases(spark), path, 8)
    before, rows = files(path), {r.case_id: r for r in ct.stored(spark, path).collect()}
    done = decisions(spark, [("c-3", "code_change", None, True, 2, 2, None, None, "agreed"), ("c-4", None, None, None, 3, 2, None, None, None), ("gone", None, None, None, None, None, True, None, "x")])
    told = ct.merge(spark, path, done, 8)
    assert told["changed"] == 2 and told["unmatched"] == 1 and told["parts"] in (1, 2)
    after = {r.case_id: r for r in ct.stored(spark, path).collect()}
    three = after["c-3"]
    assert (three.ground_truth.failure_class, three.ground_truth.subcategory, three.ground_truth.related_to_diff) == ("code_change", "randomness", True)
    assert (three.provenance.notes, three.provenance.independent_adjudications, three.provenance.adjudicators_agreeing, three.tags) == ("note 3 agreed", 2, 2, ["smoke"])
    assert (after["c-4"].provenance.adjudicators_agreeing, after["c-4"].tags) == (2, ["x"])
    assert {k: r for k, r in after.items() if k not in ("c-3", "c-4")} == {k: r for k, r in rows.items() if k not in ("c-3", "c-4")}
    parts = {r[ct.PART] for r in after.values() if r.case_id in ("c-3", "c-4")}
    kept = {f: s for f, s in before.items() if int(f.parent.name.split("=")[1]) not in parts}
    assert kept and kept.items() <= files(path).items()
    again = files(path)
    assert ct.merge(spark, path, done, 8) == {"changed": 0, "parts": 0, "unmatched": 1}
    assert files(path) == again


def test_a_persons_word(spark, tmp_path):
    import datetime

    day = datetime.date(2026, 1, 2)
    rows = {r.case_id: r for r in ct.decided(some_cases(spark, 6), decisions(spark, [("c-1", None, None, None, None, None, True, day, " confirmed "), ("c-2", None, None, None, None, None, False, day, None)])).collect()}
    one = rows["c-1"]
    assert (one.provenance.verified_by_human, one.provenance.verified_date, one.provenance.notes, one.tags, one.changed) == (True, day, "confirmed", ["smoke"], True)
    assert one.provenance.independent_adjudications == 1
    assert [rows[f"c-{i}"].changed for i in (0, 2, 3, 4, 5)] == [False] * 5


def test_two_decisions_on_one_case(spark, tmp_path):
    path = str(tmp_path / "cases")
    ct.store(some_cases(spark, 3), path, 2)
    row = ("c-1", None, None, None, None, None, True, None, None)
    with pytest.raises(ValueError, match="two decisions on case c-1"):
        ct.merge(spark, path, decisions(spark, [row, row]), 2)
    assert ct.merge(spark, path, decisions(spark, []), 2) == {"changed": 0, "parts": 0, "unmatched": 0}


def test_folders_come_back_as_cases(spark, tmp_path):
    path = str(tmp_path / "out")
    cases = some_cases(spark, 20).repartition(3)
    texts = cases.select("case_id", F.lit("logs/a.txt").alias("name"), F.concat(F.lit("log of "), "case_id", F.lit("\r\n")).alias("text"))
    cf.write_folders(cf.folder_rows(cases, texts), path)
    back = src.load_cases(spark, path)
    assert sorted(map(str, back.drop("folder").collect())) == sorted(map(str, cases.collect()))
    assert src.misplaced(back).count() == 0 and src.missing_files(back, src.text_files(spark, path)).count() == 0
    logs = {r.case_id: r.log for r in src.case_logs(back, src.text_files(spark, path, "*.txt")).collect()}
    assert logs["c-7"] == "log of c-7\n" and len(logs) == 20
    assert not [p for p in Path(path).iterdir() if p.name.startswith("_")] and len(list(Path(path).iterdir())) <= 3
    cf.write_folders(cf.folder_rows(some_cases(spark, 22).where("case_id IN ('c-20', 'c-21')")), path)
    assert src.load_cases(spark, path).count() == 22


@pytest.mark.parametrize("bad", ["../out.txt", "/etc/x", "a//b", "C:\\x", ""])
def test_a_task_that_fails_leaves_nothing(spark, tmp_path, bad):
    path = tmp_path / "out"
    cases = some_cases(spark, 20).repartition(4)
    texts = cases.select("case_id", F.when(F.col("case_id") == "c-13", bad).otherwise("logs/a.txt").alias("name"), F.lit("t").alias("text"))
    with pytest.raises(Exception, match="no path within a case folder"):
        cf.write_folders(cf.folder_rows(cases, texts), str(path))
    assert not path.exists() or not [p for p in path.iterdir() if not p.name.startswith("_")]
