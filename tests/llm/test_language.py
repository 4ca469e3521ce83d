import random

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import language as lg

SYLLABLES = {"en": ["th", "ing", "ou", "er", "and"], "fr": ["é", "eau", "que", "ou", "è"], "de": ["sch", "ung", "ü", "er", "ß"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(n):
    rng = random.Random(1)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 60)), lang) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "s", "clash") for r in data], "doc_id long, text string, lang string, source string, label string")


def test_held_out_accuracy(spark):
    data = rows(400)
    out = lg.classify_languages(frame(spark, data), windows_per_language=150, epochs=5).toPandas()
    truth = {i: lang for i, _, lang in data}
    held = out[out.held_out]
    assert len(out) == 400 and out.score.between(0, 1).all()
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.95


def test_lang_is_no_input_of_a_prediction(spark):
    data = rows(90)
    docs = frame(spark, data)
    model = lg.train_language_model(docs, windows_per_language=50, epochs=2)
    a = lg.identify_languages(docs, model).orderBy("doc_id").collect()
    b = lg.identify_languages(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model).orderBy("doc_id").collect()
    assert a == b


def test_undetermined_long_repeated_and_empty(spark):
    data = [*rows(60), (900, None, "en"), (901, "", "fr"), (902, "12 %% \n", None), (903, "é" * 300000, "fr"), (904, "x", None), (904, "x", None), (None, "the", "en")]
    out = lg.classify_languages(frame(spark, data), windows_per_language=50, epochs=2).toPandas().fillna({"doc_id": -1})
    got = {i: list(g.lang_pred) for i, g in out.groupby("doc_id")}
    assert got[900] == got[901] == got[902] == ["und"]
    assert len(got[904]) == 2 and got[904][0] == got[904][1] != "und" and got[903] == ["fr"]
    assert (out.score[out.lang_pred == "und"] == 0).all()
    assert {r.lang_pred for r in lg.classify_languages(frame(spark, [(1, "the", None)])).collect()} == {"und"}
    assert lg.classify_languages(frame(spark, rows(3)).limit(0)).count() == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    h = 3
    table, recurrent = rng.standard_normal((256, 3 * h)) * 0.5, rng.standard_normal((h, 3 * h)) * 0.5
    x = rng.integers(0, 5, (7, 4))
    weight = rng.standard_normal((7, 4, h))

    def loss(t, r):
        state, total = np.zeros((4, h)), 0.0
        for s in range(7):
            g = 0.5 + 0.5 * np.tanh(state @ r[:, : 2 * h] + t[x[s], : 2 * h])
            c = np.tanh((g[:, h:] * state) @ r[:, 2 * h :] + t[x[s], 2 * h :])
            state = state + g[:, :h] * (c - state)
            total += (weight[s] * state).sum()
        return total

    kept = {}
    lg.run_direction(table.astype(np.float32), recurrent.astype(np.float32), x, kept)
    d_table, d_recurrent = lg.back_direction(table, recurrent, x, kept, weight)
    for array, grad in ((table, d_table), (recurrent, d_recurrent)):
        for _ in range(25):
            i = tuple(rng.integers(0, n) for n in (5 if array is table else h, 3 * h))
            old = array[i]
            array[i] = old + 1e-5
            up = loss(table, recurrent)
            array[i] = old - 1e-5
            down = loss(table, recurrent)
            array[i] = old
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-3


def test_windows_hold_every_byte():
    raw = [b"", b"abc", b"x" * 10, b"y" * 8]
    x, owner = lg.windows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 4)
    for i, r in enumerate(raw):
        assert x.T[owner == i].tobytes().rstrip(b"\0") == r


def test_prediction_equals_a_plain_loop(spark):
    """One byte after the other, in windows, on a network of random weights: labels of positions, votes of letters, the winner."""
    rng = np.random.default_rng(3)
    h, window, languages = 4, 16, ["a", "b", "c"]
    weights = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    model = lg.LanguageModel(languages, window, (weights(256, 3 * h), weights(h, 3 * h)), (weights(256, 3 * h), weights(h, 3 * h)), weights(2 * h, 3), weights(3))

    def states(direction, codes):
        table, recurrent = (a.astype(float) for a in direction)
        state, out = np.zeros(h), []
        for c in codes:
            gates = 0.5 + 0.5 * np.tanh(state @ recurrent[:, : 2 * h] + table[c, : 2 * h])
            candidate = np.tanh((gates[h:] * state) @ recurrent[:, 2 * h :] + table[c, 2 * h :])
            state = state + gates[:h] * (candidate - state)
            out.append(state)
        return out

    def plain(text):
        raw = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        votes = np.zeros(3)
        for at in range(0, len(raw), window):
            part = raw[at : at + window].ljust(window, b"\0")
            forward, backward = states(model.forward, part), states(model.backward, part[::-1])[::-1]
            for c, f, b in zip(part, forward, backward, strict=True):
                if 97 <= c <= 122 or c >= 0x80:
                    e = np.exp(np.concatenate([f, b]) @ model.output + model.bias)
                    votes += e / e.sum()
        return languages[votes.argmax()], votes.max() / votes.sum()

    texts = ["The Cat", "é", "x" * 16, "A longer text, of several windows: 123 — Straße!", "ab" * 40]
    out = lg.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in out:
        name, score = plain(texts[r.doc_id])
        assert r.lang_pred == name and abs(r.score - score) < 1e-4


def test_more_languages_than_the_full_sample_is_for(spark):
    rng = random.Random(4)
    data = [(i, " ".join(chr(0x4E00 + 40 * (i % 80) + rng.randint(0, 30)) for _ in range(20)), f"l{i % 80:02}") for i in range(640)]
    out = lg.classify_languages(frame(spark, data), hidden=4, epochs=1).toPandas()
    assert len(out) == 640 and set(out.lang_pred) <= {f"l{k:02}" for k in range(80)}
