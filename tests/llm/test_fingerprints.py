import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import fingerprints as fp
from emberline.llm import graph


def slow_walk(text):
    """(steps, {step: bit}) by one character after the other."""
    cls = fp.classes(text)
    j = p = 0
    seen = {}
    while p < len(cls):
        v = int(fp._FIXED[j % fp.PERIOD, cls[p]])
        seen[j] = v >> 1
        p += v & 1
        j += 1
    return j, seen


def words(rng, n):
    return " ".join(rng.choice(["the", "ing", "oué", "日本", "an", "st𝄞", "er"]) for _ in range(n))


@pytest.mark.parametrize("few", [0, 40])
def test_embedding_equals_single_walks(monkeypatch, few):
    monkeypatch.setattr(fp, "FEW", few)
    rng = random.Random(1)
    texts = [words(rng, rng.choice([0, 1, 5, 60, 700])) for _ in range(60)] + ["", "x", "\0a\0", "🙂" * 10]
    walked, bits = fp.embed(texts)
    for t, w, b in zip(texts, walked, bits, strict=True):
        steps, seen = slow_walk(t)
        assert w == steps
        for k, s in enumerate(fp.STEPS[: len(b)]):
            assert b[k] == seen.get(int(s), 0)


def test_texts_round_trip():
    rng = random.Random(2)
    texts = [words(rng, n) for n in (0, 1, 30, 400)]
    walked, bits = fp.embed(texts)
    prints = [fp.to_text(int(w), b) for w, b in zip(walked, bits, strict=True)]
    w2, b2 = fp.from_texts(prints)
    assert w2.tolist() == walked.tolist()
    n = min(b2.shape[1], bits.shape[1])
    assert (b2[:, :n] == bits[:, :n]).all()
    assert fp.likeness(w2, b2, w2, b2).tolist() == [1.0] * 4


def test_likeness_follows_edit_distance():
    rng = random.Random(3)
    base = words(rng, 500)
    edited = {}
    for rate in (0.0, 0.005, 0.3):
        chars = list(base)
        for i in range(len(chars)):
            if rng.random() < rate:
                chars[i] = rng.choice(["", "z", "zz"])
        edited[rate] = "".join(chars)
    other = words(rng, 500)
    walked, bits = fp.embed([base, *edited.values(), other])
    one = lambda i: fp.likeness(walked[:1], bits[:1], walked[i : i + 1], bits[i : i + 1])[0]
    assert one(1) == 1.0 and one(2) > 0.6 and one(3) < one(2) and one(4) < 0.5


def test_contract(spark, make_docs):
    rng = random.Random(4)
    rows = [(i * 3, rng.choice([None, "", "ab", words(rng, 3), words(rng, 200), words(rng, 3000)])) for i in range(150)]
    rows += [(7, "twin"), (7, "twin"), (7, "other text of the same id"), (None, "no id")]
    out = fp.compare_edited(make_docs(rows).repartition(5)).collect()
    order = sorted(((fp.NULL_ID if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        walked, bits = fp.embed([t, edited, following])
        near = lambda a: float(fp.likeness(walked[:1], bits[:1], walked[a : a + 1], bits[a : a + 1])[0])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(int(walked[0]), bits[0]), fp.to_text(int(walked[1]), bits[1]), round(near(1), 9), round(near(2), 9)))
    got = [(fp.NULL_ID if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out]
    assert sorted(got) == sorted(want)


def test_few_and_no_rows(make_docs):
    one = fp.compare_edited(make_docs([(1, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.compare_edited(make_docs([(1, "a")]).limit(0)).count() == 0


def test_copies_and_near_copies_are_one_component(spark, make_docs):
    rng = random.Random(6)
    rows, truth = [], {}
    for g in range(30):
        base = words(rng, rng.choice([40, 150, 500]))
        for k in range(rng.randint(1, 4)):
            i = len(rows)
            text = base if k < 2 else base[:-4] + "zzzz"
            rows.append((i, text))
            truth[i] = min(truth.get(("first", g), i), i)
            truth[("first", g)] = truth[i]
    prints = fp.fingerprint_texts(make_docs([*rows, (None, "x"), (900, ""), (901, "")]).select("doc_id", "text"))
    out = {r.doc_id: r.component_id for r in fp.near_by_edits(prints).collect()}
    assert {i: out[i] for i, _ in rows} == {i: truth[i] for i, _ in rows}
    assert out[None] is None and out[900] == out[901] == 900


def test_walks_on_either_side_of_a_doubling_meet_without_the_centre(spark):
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, 1024, dtype=np.uint8)
    other = rng.integers(0, 2, 1024, dtype=np.uint8)
    other[: 3 * fp.SAMPLES] = bits[: 3 * fp.SAMPLES]
    rows = [(1, fp.to_text(600, other)), (2, fp.to_text(1000, bits)), (3, fp.to_text(1030, bits))]
    out = {r.doc_id: r.component_id for r in fp.near_by_edits(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert out == {1: 1, 2: 2, 3: 2}


def test_components_equal_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = words(rng, rng.choice([4, 8, 30, 120, 400]))
        cut = rng.randint(0, len(base) * 3 // 4)
        for k in (0, len(base) // 9, len(base) // 6):
            spread = "".join(rng.choice("xyz") if k and rng.random() < 0.04 else c for c in base)
            passage = base[:cut] + "".join(rng.choice("xyz") for _ in base[cut : cut + k]) + base[cut + k :]
            rows.append((len(rows), spread if g % 2 else passage))
    walked, bits = fp.embed([t for _, t in rows])
    label = list(range(len(rows)))
    links = 0
    for i in range(len(rows)):
        near = fp.likeness(np.full(i, walked[i]), np.repeat(bits[i : i + 1], i, axis=0), walked[:i], bits[:i]) >= 0.8
        for j in np.flatnonzero(near).tolist():
            links += label[i] != label[j]
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert links > 60
    prints = spark.createDataFrame([(i, fp.to_text(int(w), b)) for (i, _), w, b in zip(rows, walked, bits, strict=True)], "doc_id long, fingerprint string")
    out = {r.doc_id: r.component_id for r in fp.near_by_edits(prints).collect()}
    assert [out[i] for i, _ in rows] == label


@pytest.mark.parametrize("place", ["spread", "passage", "head"])
def test_pairs_at_the_threshold_share_a_band(place):
    rng = np.random.default_rng(9)
    bands, bits = fp.band_choice(200_000, 0.8, 0.01)
    missed = 0
    for _ in range(300):
        longer = int(rng.integers(30, 9000))
        shorter = longer - int(rng.integers(0, longer // 50 + 1))
        n, m = (int(np.searchsorted(fp.STEPS, w)) for w in (longer, shorter))
        a = rng.integers(0, 2, (1, n), dtype=np.uint8)
        b = a.copy()
        b[:, m:] = 0
        start = np.searchsorted(fp.STEPS[:m], rng.integers(0, shorter)) if place == "passage" else 0
        for i in rng.permutation(m) if place == "spread" else np.roll(np.arange(m), -start)[rng.random(m) < 0.5]:
            b[0, i] ^= 1
            if fp.likeness(np.array([longer]), a, np.array([shorter]), b)[0] < 0.8:
                b[0, i] ^= 1
                break
        grid = fp.reaches(0.8, longer)
        keys, sketches = fp.band_keys(np.array([longer, shorter]), np.concatenate([a, b]), grid, 0, bands, bits)
        shared, x, y = np.intersect1d(*keys, return_indices=True)
        missed += not (np.bitwise_count(sketches[0][x] ^ sketches[1][y]) <= fp.SKETCH_APART).any()
    assert missed <= 3


def test_bands_do_not_grow_while_buckets_are_small():
    """Keys a text, and so what is shuffled, are the same at 47,000 and at a million fingerprints."""
    assert fp.band_choice(47_000, 0.8, 0.01) == fp.band_choice(236_000, 0.8, 0.01) == fp.band_choice(1 << 20, 0.8, 0.01)
    assert fp.band_choice(1 << 24, 0.8, 0.01)[1] > fp.band_choice(1 << 20, 0.8, 0.01)[1]


def test_verification_by_words_equals_likeness():
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(60):
        walked = int(rng.choice([0, 1, 5, 64, 128, 129, int(rng.integers(1, 60_000))]))
        bits = rng.integers(0, 2, int(np.searchsorted(fp.STEPS, walked)), dtype=np.uint8)
        for rate in (0, 0.05, 0.1, 0.12):
            shorter = walked - int(rng.integers(0, walked // 6 + 1))
            other = bits ^ (rng.random(len(bits)) < rate).astype(np.uint8)
            rows.append(fp.to_text(shorter, other[: np.searchsorted(fp.STEPS, shorter)]).encode())
    near = fp.WalkLikeness(0.8)
    among = near.among(rows)
    found = 0
    for x in range(len(rows)):
        ys = np.arange(max(0, x - 5), len(rows), 3)
        want = near.alike([rows[x]] * len(ys), [rows[y] for y in ys])
        assert among(x, ys).tolist() == want.tolist()
        found += want.sum()
    assert found > 300


@pytest.mark.parametrize(("held_rows", "in_task"), [(200_000, 20_000_000), (300, 20_000_000), (200_000, 1000)])
def test_only_members_near_to_another_label_go_on(held_rows, in_task):
    """Buckets that meet by accident give no rows; of buckets beyond the limits, all rows go on."""
    rng = np.random.default_rng(12)
    sizes = [1, 2, 3, 700, 5, *rng.integers(1, 40, 200), 1000, 260, 1]
    key = np.repeat(np.sort(rng.choice(10**6, len(sizes), replace=False)), sizes)
    sketch, wide = (rng.integers(-(2**63), 2**63, len(key), dtype=np.int64) for _ in range(2))
    label = np.arange(len(key))
    for x in rng.choice(len(key) - 7, 150, replace=False).tolist():
        y = x + int(rng.integers(1, 7))
        sketch[y], wide[y] = sketch[x] ^ 0b1011, wide[x]
        if x % 3 == 0:
            label[y] = label[x]
    table = pa.table({"key": key, "v": np.arange(len(key)), "sketch": sketch, "wide": wide, "label": label})
    got = [v for b in graph.partnered(32, held_rows, in_task)(iter(table.to_batches(max_chunksize=97))) for v in b.column("v").to_pylist()]
    bits = np.unpackbits(np.stack([sketch, wide], axis=1).view(np.uint8).reshape(len(key), 16), axis=1)
    want, whole = set(), set()
    for k in np.unique(key).tolist():
        own = np.flatnonzero(key == k)
        near = ((bits[own][:, None] != bits[own][None]).sum(2) <= 32) & (label[own][:, None] != label[own][None])
        want |= set(own[near.any(1)].tolist())
        if len(own) > min(held_rows, in_task ** 0.5 if len(own) > graph.FEW_ROWS else held_rows):
            whole |= set(own.tolist())
    assert len(got) == len(set(got)) and 100 < len(want)
    assert set(got) == want | whole
