import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from emberline.llm import resampling
from emberline.llm.resampling import Hasher, bucket_gains, joined_crc, resample


def features(text, longest=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, min_words, buckets, longest, seed):
    """[(doc_id, n_features, weight, score, rank)] by one pass after the other over lists."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in docs:
        for f in features(text, longest)[1]:
            own[bucket(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            aim[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * float(own.sum() + buckets) / ((s + 1) * float(aim.sum() + buckets)))) for s, t in zip(own.tolist(), aim.tolist(), strict=True)]
    rows = []
    for i, text in docs:
        words, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([len(words), i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[1:], ranks.get(id(r))) for r in rows), key=str)


def some_docs(n, draw):
    vocabulary = ["alpha", "Beta", "GAMMA", "naïve", "x1", "42", "漢字", "É", "z" * 70, "o", "the", "of"]
    join = [" ", ", ", "\n", "--", "’", "\x7f", "_"]
    return [(i, "".join(draw.choice(vocabulary) + draw.choice(join) for _ in range(draw.choice([0, 1, 5, 20, 60])))) for i in range(n)]


def got(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize(("percent", "min_words", "buckets", "longest"), [(25, 20, 10_000, 2), (100, 0, 7, 1), (50, 5, 65_536, 4), (0, 1, 100, 3)])
def test_equals_lists(spark, monkeypatch, percent, min_words, buckets, longest):
    draw = random.Random(longest)
    docs = some_docs(150, draw) + [(7, "again and again"), (7, "again and again"), (None, None), (None, "x " * 30), (None, "x " * 30), (500, ""), (501, "the " * 4000)]
    target = ["alpha beta naïve", None, "", "The of x"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = plain(docs, target, percent, min_words, buckets, longest, 7)
    assert got(resample(frame, aim, percent=percent, min_words=min_words, buckets=buckets, longest=longest)) == want


def test_one_hot_document_id(spark):
    """A third of all rows are the same; ranks are still 1, 2, 3 and so on."""
    docs = some_docs(200, random.Random(4)) + [(3, "alpha beta " * 15)] * 100
    rows = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("alpha beta",)], "text string"), percent=60)
    assert got(rows) == plain(docs, ["alpha beta"], 60, 20, 10_000, 2, 7)
    ranks = sorted(r.rank for r in rows.collect() if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_empty_tables_and_further_columns(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resample(make_docs([]), none).count() == 0
    docs = make_docs([(1, "a b c"), (2, "d")]).withColumnRenamed("bucket", "score")
    rows = resample(docs, none, min_words=1, percent=50)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(rows) == plain([(1, "a b c"), (2, "d")], [], 50, 1, 10_000, 2, 7)


def test_blocks_of_any_size(spark, monkeypatch):
    docs = some_docs(60, random.Random(9))
    frame, aim = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([("alpha",)], "text string")
    blocks = resampling.write_streams(frame, resampling.work_path(spark, "streams-test"), buckets=50, longest=2)
    n = sum(len(features(t)[1]) for _, t in docs)
    assert sum(r.n_features for r in blocks.collect()) == n
    assert resampling.count_array(resampling.bucket_counts(blocks), 50).sum() == n
    assert aim.count() == 1


def test_joined_crc():
    draw = random.Random(1)
    pairs = [(draw.randbytes(draw.choice([0, 1, 3, 50])), draw.randbytes(draw.choice([0, 1, 2, 31, 32, 33, 5000]))) for _ in range(300)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert joined_crc(a, b, np.array([len(p[1]) for p in pairs])).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_hasher_forgets_and_refuses(monkeypatch):
    raw = "One two, three. one".encode()
    first = [x.tolist() for x in Hasher(10_000, 3)(raw, np.array([0, 4, len(raw)]))]
    monkeypatch.setattr(resampling, "MAX_WORDS", 0)
    small = Hasher(10_000, 3)
    for _ in range(3):
        assert [x.tolist() for x in small(raw, np.array([0, 4, len(raw)]))] == first
    with pytest.raises(ValueError):
        Hasher(65_537, 2)


def test_gains_go_down():
    assert bucket_gains(np.array([9, 0]), np.array([0, 9])).tolist() == [math.floor(1000 * math.log(1 / 10)), math.floor(1000 * math.log(10))]
