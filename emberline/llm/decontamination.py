"""Benchmark decontamination by latent semantic retrieval: a randomised SVD of TF-IDF passages, made by all tasks, gives a
space in which passages near to a benchmark item are candidates; longest common subsequence and answer say which are leaks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberline.llm.common import Scratch, shuffle_partitions, text_slices
from emberline.llm.shingles import PUNCTUATED, mix, word_hashes

BLOCK_WORDS = 16
SLICE_BYTES = 1 << 20
#: Cells of terms times item passages that a worker keeps ready; beyond that scores come from vectors.
PULL_CELLS = 1 << 24


@dataclass(frozen=True)
class Settings:
    """passage_blocks blocks of 16 words make a passage, one begins at every block; items longer than item_words are cut.

    sketch_rows: rows that the passages of the documents are summed into at random, and as many for those of the items; rank:
    dimensions of the latent space. A candidate has a cosine of at least `cosine`; a passage whose vector is shorter than
    `least_norm` of the item's counts as that long. It is a leak if the longest common subsequence has `covered` of the item's
    words, or `paraphrased` of them together with `answered` of its answer's words, in order and within
    `answer_spread` times as many words (and two more). pass_words: words of items that are searched in one pass over the documents,
    some 100 bytes each are broadcast; rows of one item_id are in one pass. The space is that of all items, so it changes no result.
    term_slots: a word's term is its hash modulo this, however many words there are, so words may share a term, more of them the more items there
    are; that blurs cosines, never the checks. Tasks hold sketch_rows x term_slots numbers at most.
    """

    passage_blocks: int = 3
    item_words: int = 48
    sketch_rows: int = 96
    rank: int = 192
    cosine: float = 0.45
    least_norm: float = 0.6
    covered: float = 0.7
    paraphrased: float = 0.5
    answered: float = 0.8
    answer_spread: float = 1.5
    pass_words: int = 2_000_000
    term_slots: int = 1 << 17


@dataclass
class Vocabulary:
    """Hashes of all words of the items, sorted, and the term of each: the place of its slot among the slots that are taken."""

    words: np.ndarray
    slots: int
    table: np.ndarray = field(init=False)
    term: np.ndarray = field(init=False)
    size: int = field(init=False)

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        taken, term = np.unique(mix(self.words) % np.uint64(self.slots), return_inverse=True)
        self.term, self.size = term.astype(np.int64), len(taken)

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms): which of the words are in the vocabulary, and their terms."""
        at = np.flatnonzero(self.table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        word = np.searchsorted(self.words, hashes[at])
        word[word == len(self.words)] = 0
        known = self.words[word] == hashes[at]
        return at[known], self.term[word[known]]


@dataclass
class Items:
    """Passages of benchmark items: owner is the item of each."""

    ids: list
    owner: list[int]
    passages: list[np.ndarray]
    answers: list[np.ndarray]


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), PUNCTUATED, wide=True)[0]


def lowered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.set_column(column, batch.schema.names[column], pc.utf8_lower(batch.column(column)))


def last_sentence(text: str) -> str:
    parts = [p for p in text.replace("\n", ".").split(".") if p.strip()]
    return parts[-1] if parts else ""


def item_passages(benchmark: DataFrame, item_words: int) -> DataFrame:
    """item_id, at, words, answer: every row of benchmark(item_id, text, answer) cut to passages, words as their hashes."""
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item_id, text, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hashed(text)
                n = max(1, -(-len(words) // item_words))
                size = max(1, -(-len(words) // n))
                told = hashed(answer if answer is not None else last_sentence(text)).tobytes()
                rows += [(item_id, at, words[at : at + size].tobytes(), told) for at in range(0, len(words), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.int32(), pa.binary(), pa.binary()))], ["item_id", "at", "words", "answer"])

    item_id = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text", "answer").mapInArrow(run, f"item_id {item_id}, at int, words binary, answer binary")


def passes(passages: DataFrame, pass_words: int) -> Iterator[Items]:
    """The items in passes of about pass_words words. The driver holds one pass at a time."""
    now, size = Items([], [], [], []), 0
    for r in passages.orderBy("item_id", "words", "at", "answer").toLocalIterator():
        if not now.ids or now.ids[-1] != r["item_id"]:
            if size >= pass_words:
                yield now
                now, size = Items([], [], [], []), 0
            now.ids.append(r["item_id"])
        words = np.frombuffer(r["words"], np.uint64)
        now.owner.append(len(now.ids) - 1)
        now.passages.append(words)
        now.answers.append(np.frombuffer(r["answer"], np.uint64))
        size += len(words)
    if now.ids:
        yield now


def blocks(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each text, first block of each text, block of each known word, its term, word's place)"""
    hashes, first = word_hashes(data, offsets, PUNCTUATED, wide=True)
    counts = np.diff(first)
    first_block = np.concatenate([[0], np.cumsum(-(-counts // BLOCK_WORDS))])
    place, term = vocabulary.terms(hashes)
    text = np.searchsorted(first, place, side="right") - 1
    block = first_block[text] + (place - first[text]) // BLOCK_WORDS
    return hashes, first, first_block, block, term, place


def sketch(docs: DataFrame, vocabulary: Vocabulary, rows: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(blocks, blocks with each term, sketch) over all documents.

    The sketch sums blocks' term counts, each block into one of so many rows and with a sign, both by a hash of its words: a
    random projection of all passages that keeps their row space. Tasks sum their own, and sums are added row by row.
    """
    spark = docs.sparkSession
    size = vocabulary.size
    shipped = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        sums = np.zeros((rows, size), np.float32)
        frequency, n = np.zeros(size), 0
        for _, data, offsets in text_slices(lowered(batches, 0), "text", SLICE_BYTES):
            _, _, first_block, block, term, _ = blocks(known, data, offsets)
            n += int(first_block[-1])
            if not len(block):
                continue
            pairs = np.unique(block * size + term)
            frequency += np.bincount(pairs % size, minlength=size)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            choice = mix(np.add.reduceat(mix(term.astype(np.uint64)), starts))
            repeat = np.diff(np.append(starts, len(block)))
            row = np.repeat((choice % np.uint64(rows)).astype(np.int64), repeat)
            sign = np.repeat(np.where(choice >> np.uint64(63), 1.0, -1.0), repeat)
            np.add.at(sums, (row, term), sign.astype(np.float32))
        if n:
            full = np.flatnonzero(sums.any(axis=1))
            values = [np.array([n], np.float64).tobytes(), frequency.tobytes(), *(sums[i].astype(np.float64).tobytes() for i in full)]
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *full.tolist()], pa.int32()), pa.array(values, pa.binary())], ["row", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(value.as_buffer(), np.float64)
                total[row] = total[row] + part if row in total else part.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["row", "value"])

    parts = docs.select("text").mapInArrow(count, "row int, value binary")
    # Rows by row of the sketch: a fixed number of them, however many tasks and documents there are.
    summed = {r["row"]: np.frombuffer(r["value"], np.float64) for r in parts.repartition(min(rows + 2, shuffle_partitions(spark)), "row").mapInArrow(add, "row int, value binary").collect()}
    if -2 not in summed:
        return 0.0, np.zeros(size), np.zeros((0, size))
    return float(summed[-2][0]), summed[-1], np.array([v for k, v in sorted(summed.items()) if k >= 0]).reshape(-1, size)


@dataclass
class Space:
    """idf of each term, and its vector in the latent space (idf included)."""

    idf: np.ndarray
    terms: np.ndarray

    def vectors(self, vocabulary: Vocabulary, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(unit vectors, lengths) of passages"""
        found = np.array([self.terms[vocabulary.terms(words)[1]].sum(axis=0) for words in passages])
        lengths = np.linalg.norm(found, axis=1)
        return (found / np.maximum(lengths, 1e-12)[:, None]).astype(np.float32), lengths.astype(np.float32)


def latent_space(vocabulary: Vocabulary, items: Iterator[Items], n: float, frequency: np.ndarray, sums: np.ndarray, settings: Settings) -> Space:
    """Right singular vectors of the sketch of all passages, TF-IDF weighed: those of the documents and those of the items."""
    idf = np.log((n + 1) / (frequency + 1)) + 0.1
    own = np.zeros((max(settings.sketch_rows, settings.rank), len(idf)))
    i = 0
    for part in items:
        for words in part.passages:
            term, counts = np.unique(vocabulary.terms(words)[1], return_counts=True)
            v = counts * idf[term]
            own[i % len(own), term] += v / max(np.linalg.norm(v), 1e-12) * (1 if (i // len(own)) % 2 == 0 else -1)
            i += 1
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    both = unit(np.concatenate([sums * idf, own]))
    values, left = np.linalg.eigh(both @ both.T)
    keep = np.argsort(values)[::-1][: settings.rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-12)]
    right = (both.T @ left[:, keep]) / np.sqrt(values[keep])
    return Space(idf, (right * idf[:, None]).astype(np.float32))


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of words and the sequence whose places masks has, by bits of one number."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return size - row.bit_count()


def places(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def answer_share(masks: dict[int, int], size: int, words: list[int], spread: float) -> float:
    """The largest share of an answer of so many words that stands in order within a few more words than it has."""
    span = int(size * spread) + 2
    return max((common_subsequence(masks, size, words[i : i + span]) / size for i, w in enumerate(words) if w in masks), default=0.0)


def searches(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> Iterator[tuple[Vocabulary, Space, Items]]:
    """What each pass over the documents looks for. Items without words are none."""
    scratch = Scratch()
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    wanted = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text", answer.alias("answer"))
    passages = scratch.written(item_passages(wanted, settings.item_words), "item-passages")
    words = np.zeros(0, np.uint64)
    for part in passes(passages, settings.pass_words):  # 8 bytes for each different word of all items
        words = np.unique(np.concatenate([words, *part.passages]))
    if len(words):
        vocabulary = Vocabulary(words, settings.term_slots)
        space = latent_space(vocabulary, passes(passages, settings.pass_words), *sketch(docs, vocabulary, settings.sketch_rows), settings)
        for part in passes(passages, settings.pass_words):
            yield vocabulary, space, part
    scratch.clear()


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer_coverage: the leaks of benchmark(item_id, text[, answer]) in docs(doc_id, text).

    A row for each document and item of which a passage in the document is near in the latent space and passes the checks;
    figures are the best passage's. Without an answer column, or where it is null, an item's last sentence stands for it.
    Words go without case and punctuation; each character of Chinese and Japanese is a word. One scan of the documents
    fits the space, and one searches all items, or as many as Settings.pass_words allows; documents are never shuffled. Null and empty texts leak nothing; repeated rows give repeated results; a null doc_id is kept.
    """
    found = None
    for what in searches(docs, benchmark, settings):
        leaks = search(docs, benchmark, *what, settings)
        found = leaks if found is None else found.unionByName(leaks)
    if found is None:
        return docs.sparkSession.createDataFrame([], _leak_columns(benchmark))
    return found


def _leak_columns(benchmark: DataFrame) -> str:
    return f"doc_id long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, cosine double, coverage double, answer_coverage double"


class Searcher:
    """Leaks in texts end to end.

    Scores are linear in a passage's words: `pull` has each term's part of the score against each item, divided by the least
    score that a candidate needs whatever its own length. Sums of it leave few passages, and only these get their vectors.
    """

    def __init__(self, vocabulary: Vocabulary, space: Space, items: Items, settings: Settings):
        self.vocabulary, self.items, self.space, self.settings = vocabulary, items, space, settings
        self.unit, self.lengths = space.vectors(vocabulary, items.passages)
        self.kept: dict[tuple[bool, int], dict[int, int]] = {}
        self.floor = (0.999 * settings.cosine * (settings.least_norm * self.lengths + 1e-9)).astype(np.float32)
        self.pull = self.pulls(0, len(self.unit)) if vocabulary.size * len(self.unit) <= PULL_CELLS else None
        #: The most that one occurrence of a term can do for any item.
        self.most = np.zeros(vocabulary.size, np.float32)
        at_once = max(1, PULL_CELLS // max(vocabulary.size, 1))
        for at in range(0, len(self.unit), at_once):
            pull = self.pull if self.pull is not None else self.pulls(at, at + at_once)
            self.most = np.maximum(self.most, pull.max(axis=1, initial=0))

    def pulls(self, start: int, stop: int) -> np.ndarray:
        return np.ascontiguousarray((self.space.terms @ self.unit[start:stop].T) / self.floor[start:stop][None, :])

    def masks(self, i: int, answer: bool) -> dict[int, int]:
        """places() of passage i or of its answer."""
        if (answer, i) not in self.kept:
            if len(self.kept) > 10_000:
                self.kept.clear()
            self.kept[answer, i] = places((self.items.answers if answer else self.items.passages)[i])
        return self.kept[answer, i]

    def candidates(self, block: np.ndarray, term: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, items) whose score may be enough; end is the block after each passage, block and term are ascending."""
        total, width = len(end), self.settings.passage_blocks
        reach = np.concatenate([[0], np.cumsum(np.bincount(block, weights=self.most[term], minlength=total))])
        hopeful = reach[end] - reach[:-1] >= 1
        first = np.searchsorted(block, np.arange(total + 1))
        for at in range(0, total, 1024):
            stop = min(at + 1024, total)
            own = at + np.flatnonzero(hopeful[at:stop])
            if not len(own):
                continue
            if self.pull is None:
                vectors = self.vectors(block, term, end, own)
                for i in range(0, len(self.unit), 4096):
                    p, k = np.nonzero(vectors @ self.unit[i : i + 4096].T >= self.floor[i : i + 4096])
                    yield own[p], i + k
                continue
            lo, hi = first[at], first[min(stop + width - 1, total)]
            pulled = self.by_block(block[lo:hi] - at, term[lo:hi], stop - at + width)
            score = pulled[own - at]
            for k in range(1, width):
                rows = np.flatnonzero(own + k < end[own])
                score[rows] += pulled[own[rows] + k - at]
            p, i = np.nonzero(score >= 1)
            yield own[p], i

    def by_block(self, block: np.ndarray, term: np.ndarray, count: int) -> np.ndarray:
        """(count, items): pull summed by block: every block's first term, then every second one, and so on."""
        out = np.zeros((count, self.pull.shape[1]), np.float32)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        sizes = np.diff(np.append(starts, len(block)))
        order = np.argsort(-sizes, kind="stable")
        starts, left = starts[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        sums = np.zeros((len(starts), out.shape[1]), np.float32)
        for r, n in enumerate(left.tolist()):
            sums[:n] += self.pull[term[starts[:n] + r]]
        out[block[starts]] = sums
        return out

    def vectors(self, block: np.ndarray, term: np.ndarray, end: np.ndarray, passages: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(block, passages), np.searchsorted(block, end[passages])
        return np.array([self.space.terms[term[a:b]].sum(axis=0) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])

    def cosines(self, block: np.ndarray, term: np.ndarray, end: np.ndarray, passages: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of pairs of a passage and an item."""
        unique, place = np.unique(passages, return_inverse=True)
        vectors = self.vectors(block, term, end, unique)
        length = np.linalg.norm(vectors, axis=1)[place]
        least = self.settings.least_norm * self.lengths[which] + 1e-9
        return np.einsum("pd,pd->p", vectors[place], self.unit[which]) / np.maximum(length, least)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(text, owner): best (coverage, answer's share, cosine)}"""
        known, settings = self.items, self.settings
        hashes, first, first_block, block, term, _ = blocks(self.vocabulary, data, offsets)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(block):
            return best
        text = np.repeat(np.arange(len(first_block) - 1), np.diff(first_block))
        # a passage is a block and the next ones of its text
        end = np.minimum(np.arange(first_block[-1]) + settings.passage_blocks, first_block[text + 1])
        for passages, which in self.candidates(block, term, end):
            if not len(passages):
                continue
            cosine = self.cosines(block, term, end, passages, which)
            for x in np.flatnonzero(cosine >= settings.cosine).tolist():
                p, i = int(passages[x]), int(which[x])
                t = int(text[p])
                lo = int(first[t] + (p - first_block[t]) * BLOCK_WORDS)
                words = hashes[max(int(first[t]), lo - BLOCK_WORDS) : min(int(first[t + 1]), lo + (settings.passage_blocks + 1) * BLOCK_WORDS)].tolist()
                size = len(known.passages[i])
                coverage = common_subsequence(self.masks(i, False), size, words) / size
                if coverage < settings.paraphrased:
                    continue
                told = answer_share(self.masks(i, True), len(known.answers[i]), words, settings.answer_spread)
                if coverage >= settings.covered or told >= settings.answered:
                    key, value = (t, known.owner[i]), (coverage, told, float(cosine[x]))
                    best[key] = max(best.get(key, value), value)
        return best


def search(docs: DataFrame, benchmark: DataFrame, vocabulary: Vocabulary, space: Space, items: Items, settings: Settings) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, space, items))
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Searcher(*shipped.value, settings)
        for rows, data, offsets in text_slices(lowered(batches, 1), "text", SLICE_BYTES):
            best = find(data, offsets)
            if best:
                keys = sorted(best)
                doc_ids = rows.column(0).take(pa.array([t for t, _ in keys], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array([find.items.ids[i] for _, i in keys], kind), *(pa.array([best[k][c] for k in keys], pa.float64()) for c in (2, 0, 1))], ["doc_id", "item_id", "cosine", "coverage", "answer_coverage"])

    return docs.select("doc_id", "text").mapInArrow(run, _leak_columns(benchmark))


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the rows whose text leaks an item; all columns as they are, no row is shuffled.

    Rows without doc_id are judged by their own text, as all are.
    """
    place = docs.columns.index("text")
    kept = docs
    for what in searches(docs, benchmark, settings):
        shipped = docs.sparkSession.sparkContext.broadcast(what)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            find = Searcher(*shipped.value, settings)
            for batch in batches:
                clean = [np.ones(0, bool)]
                for rows, data, offsets in text_slices(lowered(iter([batch]), place), batch.schema.names[place], SLICE_BYTES):
                    clean.append(np.ones(rows.num_rows, bool))
                    clean[-1][[t for t, _ in find(data, offsets)]] = False
                yield batch.filter(pa.array(np.concatenate(clean)))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
