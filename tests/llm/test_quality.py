import random

from emberline.llm.quality import classify_quality


def corpus(n):
    rng = random.Random(3)
    good = ["".join(rng.choice(["the", "ing", "ou", "er", "an", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(30, 120))]
        bad = i % 3 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, make_docs):
    docs, labels = corpus(300)
    out = classify_quality(make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    truth = {i: q for i, q, _ in labels}
    held = out[out.held_out]
    assert len(out) == 300 and out.score.between(0, 1).all()
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95


def test_labels_of_held_out_rows_have_no_effect(spark, make_docs):
    docs, labels = corpus(120)
    a = classify_quality(make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    held = set(a[a.held_out].doc_id)
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    b = classify_quality(make_docs(docs), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).toPandas()
    assert a.sort_values("doc_id").score.tolist() == b.sort_values("doc_id").score.tolist()


def test_nulls_empty_long_repeated_and_no_labels(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "word " * 60000), (3, "word " * 60000), (None, "no id")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = classify_quality(docs, none).toPandas()
    assert len(out) == 5 and out.score.between(0, 1).all()
    some = spark.createDataFrame([(1, None, None), (2, 1, 0), (3, 0, 0), (9, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    again = classify_quality(docs, some).toPandas()
    assert len(again) == 5
    assert again[again.doc_id == 1].score.tolist() == again[again.doc_id == 2].score.tolist()
    assert classify_quality(docs.limit(0), none).count() == 0


def test_scores_equal_a_plain_version(spark, make_docs):
    """Sizes of blocks with either dictionary, their measures, and the logistic curve, one text after the other."""
    import math

    import zstandard
    from emberline.llm.quality import fit_quality, score_quality

    docs, labels = corpus(150)
    docs += [(900, None), (901, ""), (902, "ü" * 3000), (903, "a b " * 700)]
    frame = make_docs(docs)
    model = fit_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def plain(text):
        raw = (text or "").encode()
        sizes = []
        for content in (model.good, model.bad):
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(raw[i : i + 1024])) for i in range(0, max(len(raw), 1), 1024)))
        good, bad = sizes
        d = (bad - good) / max(sizes)
        m = [d, d * min(1, len(raw) / 500), math.log((min(sizes) + 1) / (len(raw) + 1)), math.log1p(min(len(raw), 1024))]
        x = m + [v * v for v in m] + [m[0] * m[2]]
        return 1 / (1 + math.exp(-sum(w * (v - a) / s for w, v, a, s in zip(model.weights, x, model.mean, model.scale)) - model.weights[-1]))

    texts = dict(docs)
    out = score_quality(frame, model).collect()
    assert len(out) == len(docs)
    assert all(abs(r.score - plain(texts[r.doc_id])) < 1e-6 for r in out)
