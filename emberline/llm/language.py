"""Language identification: a bidirectional gated recurrent network over bytes labels every position, and a document's
language is the one its positions are likeliest in. Trained here, in numpy, by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import bounded_texts, held_out, learns, text_slices

UNDETERMINED = "und"
#: Up to so many languages the sample of each is as large as stated; it shrinks in proportion beyond.
FULL_LANGUAGES = 64
SLICE_BYTES = 1 << 19

#: Bytes that can be part of a letter: ASCII letters and all of multi-byte sequences. Others carry no vote.
_VOTES = np.zeros(256, np.float32)
_VOTES[ord("a") : ord("z") + 1] = _VOTES[ord("A") : ord("Z") + 1] = _VOTES[0x80:] = 1
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32


@dataclass
class LanguageModel:
    """Of each direction: table[byte] (input weights and bias, for update gate, reset gate and candidate), recurrent weights.

    The output maps both states at a position to a score for each language. A text is read in windows of `window` bytes, each
    from a zero state, so any place of a long text is labelled at the same cost and with the same network.
    """

    languages: list[str]
    window: int
    forward: tuple[np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def run_direction(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States (steps, rows, h) of a gated recurrent unit over bytes x (steps, rows); keep gets what training needs.

    Gates use 0.5 + 0.5 * tanh, with the halving of their inputs put into the weights.
    """
    steps, rows = x.shape
    h3 = table.shape[1]
    h = h3 // 3
    out = np.empty((steps, rows, h), np.float32)
    state = np.zeros((rows, h), np.float32)
    gates_w, candidate_w = np.ascontiguousarray(recurrent[:, : 2 * h]), np.ascontiguousarray(recurrent[:, 2 * h :])
    gates_t, candidate_t = np.ascontiguousarray(table[:, : 2 * h]), np.ascontiguousarray(table[:, 2 * h :])
    for t in range(steps):
        g = state @ gates_w
        g += gates_t.take(x[t], axis=0)
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        z, r = g[:, :h], g[:, h:]
        c = (r * state) @ candidate_w
        c += candidate_t.take(x[t], axis=0)
        np.tanh(c, out=c)
        if keep is not None:
            keep.setdefault("z", []).append(z.copy())
            keep.setdefault("r", []).append(r.copy())
            keep.setdefault("c", []).append(c.copy())
            keep.setdefault("before", []).append(state.copy())
        c -= state
        c *= z
        state = np.add(state, c, out=out[t])
    return out


def back_direction(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, kept: dict, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and recurrent, given those of every state."""
    steps = len(x)
    h = table.shape[1] // 3
    d_table, d_recurrent = np.zeros_like(table), np.zeros_like(recurrent)
    d_state = np.zeros_like(d_out[0])
    gates_w, candidate_w = recurrent[:, : 2 * h], recurrent[:, 2 * h :]
    for t in range(steps - 1, -1, -1):
        z, r, c, before = (kept[k][t] for k in ("z", "r", "c", "before"))
        d = d_state + d_out[t]
        d_c = d * z * (1 - c * c)
        d_rs = d_c @ candidate_w.T
        # d tanh-gate: 0.5 * (1 - tanh^2), with tanh = 2 * gate - 1
        d_z = d * (c - before) * 2 * z * (1 - z)
        d_r = d_rs * before * 2 * r * (1 - r)
        d_gates = np.concatenate([d_z, d_r], axis=1)
        d_state = d * (1 - z) + d_rs * r + d_gates @ gates_w.T
        d_recurrent[:, : 2 * h] += before.T @ d_gates
        d_recurrent[:, 2 * h :] += (r * before).T @ d_c
        np.add.at(d_table, x[t], np.concatenate([d_gates, d_c], axis=1))
    return d_table, d_recurrent


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (window, rows) with zeros after a text's end, text of each row): every text in consecutive windows."""
    lengths = np.diff(offsets)
    counts = -(-lengths // window)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * window
    at = start[:, None] + np.arange(window)[None, :]
    inside = at < offsets[1:][owner][:, None]
    x = np.zeros((len(owner), window), np.uint8)
    x[inside] = data[at[inside]]
    return np.ascontiguousarray(x.T), owner


def position_probabilities(model: LanguageModel, x: np.ndarray) -> np.ndarray:
    """(window, rows, languages): each position's share of every language."""
    folded = _FOLD[x]
    f = run_direction(*model.forward, folded)
    b = run_direction(*model.backward, folded[::-1])[::-1]
    h = f.shape[2]
    scores = f.reshape(-1, h) @ model.output[:h]
    scores += b.reshape(-1, h) @ model.output[h:]
    scores += model.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores.reshape(*x.shape, -1)


def train_network(texts: list[bytes], labels: list[int], languages: list[str], *, hidden: int = 8, window: int = 128, windows_per_language: int = 1500, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 5) -> LanguageModel:
    """Fit by Adam on windows of the texts, each position labelled as its text is; every language counts alike."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    picked, wanted = [], []
    for y in range(k):
        own = [t for t, label in zip(texts, labels, strict=True) if label == y and t]
        if not own:
            continue
        data = np.frombuffer(b"".join(own), np.uint8)
        x, _ = windows(data, np.concatenate([[0], np.cumsum([len(t) for t in own])]), window)
        order = rng.permutation(x.shape[1])[:windows_per_language]
        picked.append(x[:, np.resize(order, windows_per_language)])
        wanted += [y] * windows_per_language
    x, y = _FOLD[np.concatenate(picked, axis=1)], np.array(wanted)
    votes = _VOTES[x]
    normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {"ft": normal(256, 3 * hidden), "fu": normal(hidden, 3 * hidden), "bt": normal(256, 3 * hidden), "bu": normal(hidden, 3 * hidden), "o": normal(2 * hidden, k), "c": np.zeros(k, np.float32)}
    m, v = {n: np.zeros_like(a) for n, a in p.items()}, {n: np.zeros_like(a) for n, a in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(x.shape[1])
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xs, ys, ws = x[:, rows], y[rows], votes[:, rows]
            kf: dict = {}
            kb: dict = {}
            f = run_direction(p["ft"], p["fu"], xs, kf)
            b = run_direction(p["bt"], p["bu"], xs[::-1], kb)[::-1]
            both = np.concatenate([f, b], axis=2)
            scores = both @ p["o"] + p["c"]
            scores -= scores.max(axis=2, keepdims=True)
            prob = np.exp(scores)
            prob /= prob.sum(axis=2, keepdims=True)
            prob[:, np.arange(len(rows)), ys] -= 1
            d = prob * (ws / max(ws.sum(), 1))[:, :, None]
            flat = d.reshape(-1, k)
            grads = {"o": both.reshape(-1, 2 * hidden).T @ flat, "c": flat.sum(0)}
            d_both = (flat @ p["o"].T).reshape(both.shape)
            grads["ft"], grads["fu"] = back_direction(p["ft"], p["fu"], xs, kf, d_both[:, :, :hidden])
            grads["bt"], grads["bu"] = back_direction(p["bt"], p["bu"], xs[::-1], kb, d_both[::-1, :, hidden:])
            step += 1
            now = rate * (1 - epoch / epochs)
            for n, g in grads.items():
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.01 * (g * g - v[n])
                p[n] -= now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(languages, window, (p["ft"], p["fu"]), (p["bt"], p["bu"]), p["o"], p["c"])


def train_language_model(docs: DataFrame, *, docs_per_language: int = 250, bytes_per_language: int = 400_000, **settings) -> LanguageModel | None:
    """A model of docs(doc_id, text, lang), from at most docs_per_language documents and about bytes_per_language bytes of each.

    Only rows that learns() allows, with text and lang, are looked at; which of them goes by a hash of doc_id. With over 64
    languages, the bounds shrink so that the whole sample is no larger than for 64. None if there are no such rows.
    """
    usable = docs.where(learns() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))
    # One row a language.
    languages = sorted(r[0] for r in usable.where(F.octet_length("text") > 0).select("label").distinct().collect())
    if not languages:
        return None
    part = min(1.0, FULL_LANGUAGES / len(languages))
    rows = bounded_texts(usable, languages, max(4, int(docs_per_language * part)), max(4096, int(bytes_per_language * part)))
    place = {name: i for i, name in enumerate(languages)}
    if "windows_per_language" not in settings:
        settings["windows_per_language"] = max(16, int(1500 * part))
    return train_network([r["text"].encode() for r in rows], [place[r["label"]] for r in rows], languages, **settings)


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text); only the text is looked at.

    Every byte of a text is labelled; those of letters vote with their probabilities, and score is the winner's share. `und`
    with score 0 if the text is null or has no letter, or there is no model.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(lettered, F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for rows, data, offsets in text_slices(batches, "text", SLICE_BYTES):
            total = np.zeros((rows.num_rows, len(net.languages)))
            x, owner = windows(data, offsets, net.window)
            for at in range(0, x.shape[1], 4096):  # a long text alone may fill many slices
                part = x[:, at : at + 4096]
                votes = np.einsum("trk,tr->rk", position_probabilities(net, part), _VOTES[part])
                np.add.at(total, owner[at : at + 4096], votes)
            weight = total.sum(axis=1)
            share = total / np.maximum(weight, 1e-9)[:, None]
            best = share.argmax(axis=1)
            known = np.diff(offsets) > 0
            names = [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
            score = np.where(known, np.minimum(share[np.arange(len(best)), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def classify_languages(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learnt from the rows not held out."""
    model = train_language_model(docs, **settings)
    return identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
