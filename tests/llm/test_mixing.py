import random
from fractions import Fraction

import numpy as np
import pytest

from emberline.llm import mixing
from emberline.llm.mixing import NO_SOURCE, in_order, mix, plan


def ideal(blocks, weights):
    """After each turn, what an ideal has sent of each source: all that last at once, in proportion to their weights. Exact, step by step."""
    left = {s: Fraction(n) for s, n in blocks.items() if n}
    sent = {s: Fraction(0) for s in left}
    out = []
    for _ in range(sum(blocks.values())):
        room = Fraction(1)
        while room and left:
            total = sum(Fraction(weights[s]) for s in left)
            step = min(room, *(n * total / Fraction(weights[s]) for s, n in left.items()))
            for s in list(left):
                part = step * Fraction(weights[s]) / total
                sent[s] += part
                left[s] -= part
                if not left[s]:
                    del left[s]
            room -= step
        out.append(dict(sent))
    return out


def turns(planned):
    """The source of each turn; every turn is one block's."""
    by_turn = {int(t): s for s, ts in planned.slots.items() for t in ts}
    assert sorted(by_turn) == list(range(sum(len(ts) for ts in planned.slots.values())))
    return [by_turn[t] for t in range(len(by_turn))]


@pytest.mark.parametrize("seed", range(12))
def test_less_than_one_block_off_from_the_first_turn_to_the_last(seed):
    """Whatever sources end on the way, against exact fractions."""
    rng = random.Random(seed)
    blocks = {f"s{i}": rng.randint(0, rng.choice([3, 12, 60])) for i in range(rng.randint(1, 14))}
    weights = {s: rng.choice([n + 1, 1, rng.randint(1, 9)]) for s, n in blocks.items()}
    order = turns(plan(blocks, weights))
    sent = dict.fromkeys(blocks, 0)
    for s, told in zip(order, ideal(blocks, weights), strict=True):
        sent[s] += 1
        for name, want in told.items():
            assert abs(sent[name] - want) < 1
    assert sent == blocks


@pytest.mark.parametrize("power", [0.5, 0.0, 1.0])
def test_500_sources_of_pareto_sizes(power):
    """Less than one block off in every round, by sums of doubles; most sources end on the way."""
    rng = np.random.default_rng(3)
    n = np.minimum(np.ceil(2 * rng.pareto(0.9, 500) + 1), 4000).astype(int)
    w = n.astype(float) ** power
    planned = plan({f"s{i:03}": int(k) for i, k in enumerate(n)}, {f"s{i:03}": x for i, x in enumerate(w)})
    order = np.array([int(s[1:]) for s in turns(planned)])
    assert len(planned.starts) > (50 if power < 1 else 0)
    gone, level, done = np.zeros(500), 0.0, np.zeros(500, int)
    ends = n / w
    for s in order:
        done[s] += 1
        room = 1.0
        while room > 1e-12 and (ends > level).any():
            lasting = w[ends > level].sum()
            step = min(room / lasting, ends[ends > level].min() - level)
            level += step
            room -= step * lasting
            if ends[ends > level].size and ends[ends > level].min() - level < 1e-13:
                level = ends[ends > level].min()
        gone = np.minimum(n, w * level)
        assert np.abs(done - gone).max() < 1 + 1e-7
    assert (done == n).all()


def test_sources_without_weight_come_last_and_rounds_begin_where_sources_end():
    planned = plan({"a": 4, "b": 2, "none": 3, "empty": 0}, {"a": 1.0, "b": 1.0, "empty": 5.0})
    assert turns(planned)[6:] == ["none"] * 3 and planned.starts.tolist() == [0, 4, 6]
    assert planned.rounds(np.arange(9)).tolist() == [0] * 4 + [1] * 2 + [2] * 3
    assert plan({}, {}).slots == {} and plan({"x": 0}, {"x": 1.0}).slots == {}


def simulate(rows, weights, block_rows, key):
    """The order of a single loop over turns, the block that is due first among those released, by exact windows."""
    blocks = {}
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s), key=key)
        blocks[s] = [own[i : i + block_rows] for i in range(0, len(own), block_rows)]
    counts = {s: len(b) for s, b in blocks.items()}
    told = [dict.fromkeys(counts, Fraction(0)), *ideal(counts, weights)]
    # the turn by whose end, and after whose end, the ideal has sent so much of a source
    by = lambda s, much: next(t for t, x in enumerate(told) if x[s] >= much)
    after = lambda s, much: max(t for t, x in enumerate(told) if x[s] <= much)
    windows = sorted((after(s, k), by(s, k + 1), s, k) for s in counts for k in range(counts[s]))
    out, left = [], windows
    for t in range(sum(counts.values())):
        _, _, s, k = pick = min((x for x in left if x[0] <= t), key=lambda x: x[1:])
        left.remove(pick)
        assert pick[0] <= t < pick[1]
        out += blocks[s][k]
    return out


def test_mix_equals_a_loop_and_keeps_every_row(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), f"text {i}") for i in range(700)] + [(5, "a", "again"), (5, "a", "again"), (None, "b", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, block string, rank int")
    mixed = mix(docs, weights={"a": 2.0, "b": 5.0, "c": 2.0, NO_SOURCE: 1.0}, block_rows=4)
    got = mixed.orderBy("mix_place").collect()
    places = [r.mix_place for r in got]
    assert len(set(places)) == len(rows) == len(got)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).distinct().collect()}
    none_first = lambda v: (v is not None, v)
    named = [(i, s if s is not None else NO_SOURCE, t) for i, s, t in rows]
    truth = simulate(named, {"a": 2.0, "b": 5.0, "c": 2.0, NO_SOURCE: 1.0}, 4, lambda r: (hashes[r[0]], none_first(r[0]), none_first(r[2])))
    assert [(r.doc_id, r.text) for r in got] == [(i, t) for i, _, t in truth]
    assert in_order(mixed).columns == docs.columns
    assert sorted(in_order(mixed).select("doc_id").na.fill(-1).collect()) == sorted(docs.select("doc_id").na.fill(-1).collect())


def test_target_shares_hold_in_the_first_round(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'mid' ELSE 'rare' END AS source")
    target = {"hot": 0.5, "mid": 0.3, "rare": 0.2}
    got = mix(docs, weights=target, block_rows=8).where("mix_round = 0").toPandas()
    n = len(got)
    assert n > 9000
    for s, w in target.items():
        assert abs((got.source == s).sum() - w * n) <= 8
        first = got[got.mix_slot < 137]
        assert abs((first.source == s).sum() / 8 - w * 137) < 1


def test_empty_and_one_source(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, source string")
    assert mix(docs.limit(0)).count() == 0
    assert [r.mix_place for r in mix(docs).orderBy("mix_place").collect()] == [0, 1]


def test_columns_of_any_name_stay(spark):
    names = ["ranges", "turns", "slots", "turn", "mix_source", "mix_rank", "mix_before", "mix_place", "row", "n"]
    docs = spark.range(50).selectExpr("id AS doc_id", "CONCAT('s', id % 3) AS source", *[f"CONCAT('{n}', id) AS {n}" for n in names])
    mixed = mix(docs, block_rows=2)
    assert mixed.columns == [*docs.columns, "mix_round", "mix_block", "mix_slot", "mix_place_"]
    assert sorted(mixed.select(*docs.columns).collect()) == sorted(docs.collect())
    assert sorted(in_order(mixed).collect()) == sorted(docs.collect()) and in_order(mixed).columns == docs.columns


@pytest.mark.parametrize("weights", [None, {f"s{i}": 1.0 + i % 5 for i in range(190)}])
def test_more_sources_than_lanes(spark, weights):
    sizes = [400, 300, *[3 + i % 40 for i in range(198)]]
    rows = [(k * 1000 + i, f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mix(docs, weights=weights, block_rows=1, max_sources=20).orderBy("mix_place").collect()
    assert sorted((r.doc_id, r.source) for r in got) == rows
    assert len({r.mix_place for r in got}) == len(rows)
    wanted = {f"s{k}": n**0.5 for k, n in enumerate(sizes)} if weights is None else weights
    first = [r for r in got if r.mix_round == 0]
    total = sum(wanted.values())
    assert len(first) > 100
    for k in range(2):  # sources with lanes of their own
        sent = 0
        for t, r in enumerate(first):
            sent += r.source == f"s{k}"
            assert abs(sent - wanted[f"s{k}"] / total * (t + 1)) < 1


def test_a_source_of_small_weight_has_its_slots():
    """200,000 turns and a share of 0.0003: any prefix is less than a block off."""
    weights = {"a": 0.61803, "b": 0.2971, "c": 0.08457, "rare": 0.0003}
    blocks = {s: int(w * 200_000) + 5 for s, w in weights.items()}
    planned = plan(blocks, weights)
    total = sum(weights.values())
    assert planned.starts[1] > 190_000
    for s, places in planned.slots.items():
        want = weights[s] / total
        for k, t in enumerate(places.tolist()):
            if t < planned.starts[1] - 1:
                assert abs(k + 1 - want * (t + 1)) < 1 and abs(k - want * t) < 1


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_a_plan_in_slices_is_the_plan(size):
    rng = random.Random(size)
    for _ in range(12):
        blocks = {f"s{i}": rng.randint(0, rng.choice([3, 40, 300])) for i in range(rng.randint(1, 12))}
        weights = {s: rng.choice([0, (n + 1) ** 0.5, 1, rng.randint(1, 9)]) for s, n in blocks.items()}
        planned = plan(blocks, weights)
        rows = [r for part in mixing.plan_slices(blocks, weights, size) for r in part.to_pylist()]
        assert len(rows) == sum(blocks.values())
        for r in rows:
            slot = planned.slots[r["mix_lane"]][r["mix_block"]]
            assert (slot, planned.rounds(slot)) == (r["slot"], r["turn"])


def test_blocks_beyond_the_held_plan_stay_as_long(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CONCAT('s', CAST(SQRT(id) AS INT) % 7) AS source")
    want = sorted(mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 50)
    monkeypatch.setattr(mixing, "SLICE", 40)
    assert sorted(mix(docs).collect()) == want
