"""Quality classifier by compression: dictionaries built from good and from bad labelled text; the smaller a text gets
with one of them against the other, the likelier its label. The curve that turns the normalised size difference into a score
is also told how far the text gets compressed at all, and its length: junk that is like neither dictionary shows there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import bounded_texts, dictionary, held_out, learns, text_slices

SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class QualityModel:
    """Contents of both dictionaries, and a logistic curve over the standardised measures of a text."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    block_bytes: int = 1024
    level: int = 1


class Measure:
    """Compressed sizes of whole texts, block by block, so that a dictionary counts as much at the end of a long text."""

    def __init__(self, good: bytes, bad: bytes, block_bytes: int, level: int):
        self.block_bytes = block_bytes
        self.coders = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[float, ...]:
        """(normalised size difference, the same weighed by length, log of the compression ratio, log of the length)"""
        step = self.block_bytes
        blocks = [text[i : i + step] for i in range(0, len(text), step)] or [b""]
        good, bad = (sum(len(coder.compress(b)) for b in blocks) for coder in self.coders)
        difference = (bad - good) / max(good, bad, 1)
        ratio = np.log((min(good, bad) + 1) / (len(text) + 1))
        return difference, difference * min(1.0, len(text) / 500), ratio, np.log1p(min(len(text), step))


def expand(measures: np.ndarray) -> np.ndarray:
    return np.concatenate([measures, measures**2, measures[:, :1] * measures[:, 2:3]], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method with a ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_quality(labelled: DataFrame, *, prior: float | None = None, max_docs_per_class: int = 3000, max_bytes_per_class: int = 8_000_000, dictionary_bytes: int = 65_536, block_bytes: int = 1024, level: int = 1) -> QualityModel:
    """A model of labelled(doc_id, text, label 0/1), from a bounded sample of its rows.

    Of each label at most max_docs_per_class documents and about max_bytes_per_class bytes are used, by hash of doc_id: one
    half of them makes the dictionaries, the other half the calibration. prior is label 1's share of the whole table, if the
    sample's is another. Null labels and texts are left out. With one label only, or none, the score is that share (0.5 if
    none).
    """
    rows = bounded_texts(labelled.where("text IS NOT NULL AND label IN (0, 1)"), [0, 1], max_docs_per_class, max_bytes_per_class)
    share = prior if prior is not None else float(np.mean([r["label"] for r in rows])) if rows else None
    halves: dict[tuple[int, int], list[bytes]] = {(label, half): [] for label in (0, 1) for half in (0, 1)}
    counts = [0, 0]
    for r in rows:
        halves[r["label"], counts[r["label"]] % 2].append(r["text"].encode())
        counts[r["label"]] += 1

    def content(label: int) -> bytes:
        blocks = [t[i : i + block_bytes] for t in halves[label, 0] for i in range(0, len(t), block_bytes)]
        return dictionary([b for b in blocks if len(b) >= 32] or blocks, dictionary_bytes).as_bytes()

    good, bad = content(1), content(0)
    measure = Measure(good, bad, block_bytes, level)
    n = 9
    if min(len(halves[0, 1]), len(halves[1, 1])) < 2:
        odds = 0.0 if share is None else np.log(max(share, 0.01) / max(1 - share, 0.01))
        return QualityModel(good, bad, (*[0.0] * n, float(odds)), (0.0,) * n, (1.0,) * n, block_bytes, level)
    texts = [(t, label) for label in (0, 1) for t in halves[label, 1]]
    x = expand(np.array([measure(t) for t, _ in texts]))
    y = np.array([label for _, label in texts], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = fit_logistic((x - mean) / scale, y)
    # The sample may hold the labels in other shares than the table does.
    share = min(max(share, 0.01), 0.99)
    w[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return QualityModel(good, bad, tuple(w), tuple(mean), tuple(scale), block_bytes, level)


class Scorer:
    def __init__(self, model: QualityModel):
        self.measure = Measure(model.good, model.bad, model.block_bytes, model.level)
        self.weights, self.mean, self.scale = np.array(model.weights), np.array(model.mean), np.array(model.scale)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = (expand(np.array([self.measure(t) for t in texts])) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def column(self, batch: pa.RecordBatch, name: str) -> np.ndarray:
        """Scores of a batch of texts, of which some MB at a time are copied."""
        scores = []
        for _, data, offsets in text_slices(iter([batch]), name, SLICE_BYTES):
            raw = data.tobytes()
            scores.append(self([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]))
        return np.concatenate(scores)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score in [0, 1], predicted 0/1 for every row of docs(doc_id, text); only the text is looked at.

    A null or empty text is scored as an empty one. Repeated rows give repeated results.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            score = scorer.column(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores least or more, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shipped.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(score.column(batch, "text") >= least))

    return docs.mapInArrow(run, docs.schema)


def sampled_labels(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """The first per_class usable label rows of each value in the order of a hash of doc_id: at most a few thousand rows."""
    one = labels.where(F.col(column).isNotNull() & learns()).groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("most")).where(F.col(column) == F.col("most")).drop("most")
    parts = [one.where(F.col(column) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_docs_per_class: int = 3000, max_bytes_per_class: int = 8_000_000) -> QualityModel:
    """A model from labels.quality of the rows of docs that are not held out.

    The label rows that may be used are cut to 2 * max_docs_per_class before they are joined, so the broadcast is bounded.
    """
    chosen = sampled_labels(labels, "quality", max_docs_per_class)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int").alias("label"))), "doc_id")
    prior = labels.where(learns()).agg(F.avg("quality")).first()[0]
    return train_quality(labelled.select("doc_id", "text", "label"), prior=prior, max_docs_per_class=max_docs_per_class, max_bytes_per_class=max_bytes_per_class)


def classify_quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learnt from labels.quality of the rows not held out."""
    return score_quality(docs, fit_quality(docs, labels, **bounds)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
