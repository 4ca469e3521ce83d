import random

import numpy as np
import pytest
from brute import near_components, shingle_set

from emberline.llm import graph
from emberline.llm.graph import components
from emberline.llm.minhash import Bands, Signer, near_duplicates
from emberline.llm.shingles import mix, shingle_sets


def edited(rng, words, rate):
    return [rng.choice("abcdefgh") * rng.randint(1, 4) if rng.random() < rate else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bcdfg" for b in ("a", "e", "ou", "ing")]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.08]))))
    docs += ["", " \t\n", "One", "one", "one two", "One\vTwo", "two one", "é à", "É à"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 2), (3, 5)])
def test_equals_all_pairs(make_docs, seed, words):
    rows = corpus(seed)
    out = near_duplicates(make_docs(rows), words=words, percent=80).toPandas()
    truth = near_components(rows, words, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.itertuples())


def test_a_bucket_whose_smallest_member_is_alike_to_few(make_docs):
    """A chain: each text is near to the next two only, so stars alone would miss links."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(140)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    out = near_duplicates(make_docs(rows), words=2, percent=80, bands=Bands(64, 3)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == near_components(rows, 2, 80)


def test_nulls_repeats_long_and_empty(make_docs):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = make_docs([(5, None), (4, "a b c"), (4, "a b c"), (3, "A b c"), (None, "a b c"), (7, long), (2, long + " end"), (9, "")])
    out = near_duplicates(docs, words=2).toPandas()
    found = sorted((r.doc_id, r.component_id, r.kept) for r in out.dropna().itertuples())
    assert found == [(2, 2, True), (3, 3, True), (4, 3, False), (4, 3, False), (5, 5, True), (7, 2, False), (9, 9, True)]
    lone = out[out.doc_id.isna()]
    assert len(lone) == 1 and lone.component_id.isna().all() and lone.kept.all()
    assert near_duplicates(docs.limit(0)).count() == 0


def test_shingle_hashes_are_the_sets():
    texts = ["a b  a b c", "", "x", "A\tb\nA b", "é É", "q " * 50, "a b c d"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for n in (1, 2, 3, 5):
        sets = shingle_sets(data, offsets, n)
        assert [len(s) for s in sets] == [len(shingle_set(t, n)) for t in texts]
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert len(np.intersect1d(sets[i], sets[j])) == len(shingle_set(a, n) & shingle_set(b, n))


def test_bands_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    sign = Signer(Bands(160, 1))
    for size in (4, 12, 60, 1000):
        agree = []
        for _ in range(60):
            common, rest = mix(rng.integers(0, 2**63, size).astype(np.uint64)), mix(rng.integers(0, 2**63, size).astype(np.uint64))
            a = np.sort(np.concatenate([common, rest[: size // 4]]))
            b = np.sort(common)
            agree.append((sign(a) == sign(b)).mean())
        assert abs(np.mean(agree) - size / (size + size // 4)) < 0.05


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        r, s = sorted((root(a), root(b)))
        parent[s] = r
    frame = spark.createDataFrame(pairs, "a long, b long")
    out = {r.v: r.label for r in components(frame).collect()}
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert {r.v: r.label for r in components(frame).collect()} == out
    assert out == {v: root(v) for p in pairs if p[0] != p[1] for v in p}


def test_long_words_of_equal_letter_counts_are_unlike(make_docs):
    """Thue-Morse words: polynomial hashes modulo 2**64 of them and their complements are equal at any base."""
    thue, other = "a", "b"
    for _ in range(10):
        thue, other = thue + other, other + thue
    out = {r.doc_id: r for r in near_duplicates(make_docs([(1, f"{thue} x"), (2, f"{other} x"), (3, f"{thue} {other} {other} {thue}")]), words=2).collect()}
    assert [out[i].component_id for i in (1, 2, 3)] == [1, 2, 3] and out[3].n_shingles == 3


def test_two_clusters_in_one_bucket_and_loose_members(make_docs):
    """Groups of copies that share a part, so that buckets hold several groups: further stars and blocks connect them."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(50)]
    rows = []
    for g in range(4):
        own = [f"g{g}w{i}" for i in range(30)]
        for _ in range(25):
            words = common + own
            words[rng.randint(0, 79)] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    out = near_duplicates(make_docs(rows), words=2, percent=80, bands=Bands(40, 2)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == near_components(rows, 2, 80)
