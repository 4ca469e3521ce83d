"""Byte-pair encoding and decoding with a public tokenizer's vocabulary; the merges run in numpy, for many words at once.

A text's words are found first: for a pre-tokenizer that splits by one pattern of letters, numbers and the rest, by classes of
code points in arrays; for others, and for texts with rare characters in them, by the tokenizer's own normalizer and
pre-tokenizer. Each different word is merged once: the symbols of all new words stand in one flat array, and a round merges
the pair of lowest rank of every word that still has one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import fresh, text_slices
from emberline.llm.token_files import spread

#: Texts whose words are found together, in bytes; longer texts go by parts.
SLICE_BYTES = 1 << 19
#: Ids that are decoded together.
SLICE_IDS = 1 << 18
NO_RANK = np.iinfo(np.int64).max
_PART_END = re.compile(r"[A-Za-z] ")

#: Fixed value: the pattern of this kind of tokenizer, without the order of its contractions.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may follow an apostrophe in that pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that are looked up in a table: Latin, Greek and Cyrillic letters, punctuation, signs, kana, Chinese characters.
TABLE_RANGES = ((0x00, 0x250), (0x370, 0x530), (0x2000, 0x2C00), (0x3000, 0x3100), (0x4E00, 0xA000))
SPACE, LETTER, NUMBER, OTHER, RARE = range(5)


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies spell each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spelled = {b: chr(b) for b in seen}
    for b in range(256):
        if b not in spelled:
            spelled[b] = chr(256 + len(spelled) - len(seen))
    return [spelled[b] for b in range(256)]


class MergeTable:
    """Pairs of symbol ids in the order of left * size + right, with the rank of each and the id it becomes."""

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]):
        self.size = max(ids.values()) + 1
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        # Of a pair that is listed again the last rank counts, as in a mapping.
        last = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][last], order[last]
        self.product = np.array([ids[a + b] for a, b in merges], np.int64)
        made = np.full(self.size, -1, np.int64)
        np.maximum.at(made, self.product, np.arange(len(merges)))
        #: Whether a merge never makes a pair of lower rank, so all equal pairs of a word can be merged in one round.
        self.rising = bool((np.maximum(made[left], made[right]) < np.arange(len(merges))).all())

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merged(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end after their merges, how many each has); no word is empty.

        In a round, every word's lowest rank is found and its pairs are merged from the left. Words without a pair leave.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = self._ranks_at(ids, word, np.arange(len(ids)))
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            hit = rank == np.repeat(least, counts)
            if least.max() == NO_RANK:
                going = np.repeat(least < NO_RANK, counts)
                done_ids.append(ids[~going])
                done_words.append(word[~going])
                ids, word, rank, hit = ids[going], word[going], rank[going], hit[going]
            at = np.flatnonzero(hit)
            if self.rising:  # of equal pairs that overlap, every second one
                begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            else:
                at = at[np.diff(word[at], prepend=-1) > 0]
            ids[at] = self.product[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged symbols stand now
            near = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            rank[near] = self._ranks_at(ids, word, near)
        ids, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_words))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(lengths))

    def _ranks_at(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places; the last symbol of a word begins none."""
        after = np.minimum(at + 1, len(ids) - 1)
        inside = (after > at) & (word[after] == word[at])
        rank = np.full(len(at), NO_RANK)
        rank[inside] = self.ranks_of(ids[at[inside]], ids[after[inside]])
        return rank


class Words:
    """The ids of words met before, as spans of one array. Beyond max_words, or as many letters as 20 for each of them, all
    are forgotten, which changes no result."""

    def __init__(self, max_words: int):
        self.max_words = max_words
        self.clear()

    @property
    def full(self) -> bool:
        return len(self.place) > self.max_words or self.letters > 20 * self.max_words

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.letters = 0
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.letters += sum(map(len, words))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])


class Encoder:
    """A tokenizer file's encoding of whole texts, equal to that of the tokenizers library with add_special_tokens=False."""

    def __init__(self, path: str, max_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What a file says on cutting and filling up texts isn't used.
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(self.tokenizer.to_str())
        model = told["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix") and model.get("unk_token") is None
        flagged = [t["content"] for t in told["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and told["normalizer"])]
        if not plain or flagged:
            raise ValueError(f"{path} is no plain BPE tokenizer")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ignore_merges = bool(model.get("ignore_merges"))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = MergeTable(merges, self.vocabulary)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"] if t["content"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.decoder = (told["decoder"] or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path} has a decoder of kind {self.decoder}")
        self.symbols = byte_symbols()
        self.words, self.pre_tokens = Words(max_words), Words(max_words)
        self.by_classes = self._splits_so(told)
        self.long_by_parts = self.by_classes or (not told["normalizer"] and (told["pre_tokenizer"] or {}).get("type") == "ByteLevel" and told["pre_tokenizer"].get("use_regex", True))
        if self.by_classes:
            self._fill_tables(told["pre_tokenizer"]["pretokenizers"][0])
            self.byte_ids = np.array([self.vocabulary[s] for s in self.symbols], np.int64)
            self.last_ids = np.array([self.vocabulary[s + self.suffix] for s in self.symbols], np.int64)

    def _splits_so(self, told: dict) -> bool:
        """Whether texts are made NFC, freed of repeated spaces, lower-cased, and split by WORD_PATTERN into bytes."""
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return False
        split = steps[0]
        if split["pattern"] != {"Regex": WORD_PATTERN} or split["behavior"] != "Removed" or not split["invert"]:
            return False
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        spelled = all(s in self.vocabulary and s + self.suffix in self.vocabulary for s in self.symbols)
        return kinds == ["NFC", "Replace", "Lowercase"] and spelled and not self.ignore_merges

    def _fill_tables(self, split: dict) -> None:
        """lower and kind of each code point of TABLE_RANGES, as the library itself has them; all others are RARE.

        So are characters that can join with one before them in NFC, and those whose lower case is several characters.
        """
        from tokenizers import Regex, pre_tokenizers

        cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        normal = self.tokenizer.normalizer.normalize_str
        joins = set()
        for c in range(0x110000):
            parts = unicodedata.decomposition(chr(c)).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                joins.add(int(parts[1], 16))
        self.lower = np.arange(0x10000, dtype=np.uint32)
        self.kind = np.full(0x10001, RARE, np.uint8)  # the last one stands for all beyond
        for c in (x for a, b in TABLE_RANGES for x in range(a, b)):
            text = normal(chr(c))
            if len(text) != 1 or c in joins or ord(text) in joins or unicodedata.combining(chr(c)) or ord(text) > 0xFFFF:
                continue
            found = cut.pre_tokenize_str(f"a{text}{text}a")
            kind = {1: LETTER, 2: SPACE, 3: OTHER, 4: NUMBER}[len(found)]
            self.lower[c], self.kind[c] = ord(text), kind

    def _merge(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(s) for s in symbols], np.int64)
        return self.merges.merged(np.concatenate(symbols), lengths)

    def _look_up(self, known: Words, words: list[str], spell) -> np.ndarray:
        """Places in known of words, after those that are new have been merged."""
        if known.full:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known.place]
        if new:
            ids, counts = spell(new)
            known.add(new, ids, counts)
        return np.fromiter(map(known.place.__getitem__, words), np.int64, len(words))

    def _spell_bytes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = "".join(words).encode()
        lengths = np.array([len(w.encode()) for w in words], np.int64)
        data = np.frombuffer(raw, np.uint8)
        ids, last = self.byte_ids[data], np.cumsum(lengths) - 1
        ids[last] = self.last_ids[data[last]]
        return self.merges.merged(ids, lengths)

    def _spell_symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of pre-tokens as the library gives them. A symbol that the vocabulary lacks has no id."""
        spelled = []
        for w in words:
            whole = self.vocabulary.get(w) if self.ignore_merges else None
            names = [w] if whole is not None else [*w[:-1], w[-1] + self.suffix]
            spelled.append(np.array([self.vocabulary[n] for n in names if n in self.vocabulary], np.int64))
        full = [s for s in spelled if len(s)]
        counts = np.zeros(len(words), np.int64)
        if not full:
            return np.zeros(0, np.int64), counts
        ids, n = self._merge(full)
        counts[[i for i, s in enumerate(spelled) if len(s)]] = n
        return ids, counts

    def _class_words(self, points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first code points, ends) of the words of a lower-cased text, by the classes of neighbours."""
        begin = np.ones(len(points), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(points))
        # An apostrophe alone takes the first letters of the run after it, if they are one of CONTRACTIONS.
        quote = np.flatnonzero((points[start] == ord("'")) & (end - start == 1) & (kind[np.minimum(end, len(points) - 1)] == LETTER) & (end < len(points)))
        if len(quote):
            first = end[quote]
            room = end[quote + 1] - first
            a, b = points[first], np.where(room > 1, points[np.minimum(first + 1, len(points) - 1)], 0)
            taken = np.zeros(len(quote), np.int64)
            for tail in CONTRACTIONS:
                fits = (a == ord(tail[0])) & ((b == ord(tail[1])) if len(tail) == 2 else True)
                taken[(taken == 0) & fits] = len(tail)
            end[quote] += taken
            start[quote + 1] += taken
        word = (kind[start - (start == len(points))] != SPACE) & (start < end)
        return start[word], end[word]

    def _fast(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in self.words, code points at which they begin) of texts end to end, with a space after each."""
        kind, points = self.kind[points], self.lower[points]
        start, end = self._class_words(points, kind)
        lowered = points.astype("<u4").tobytes().decode("utf-32-le")
        words = [lowered[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return self._look_up(self.words, words, self._spell_bytes), start

    def _slow(self, text: str) -> np.ndarray:
        """The ids of a text without added tokens, by the library's own normalizer and pre-tokenizer."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        pre = self.tokenizer.pre_tokenizer
        words = [w for w, _ in pre.pre_tokenize_str(text)] if pre is not None else [text]
        known = self.pre_tokens
        at = self._look_up(known, [w for w in words if w], self._spell_symbols)
        return known.ids[spread(known.starts[at], known.counts[at])]

    def _parts(self, text: str) -> list[str]:
        """A long text in parts that no word crosses: cut before a space after a letter, where the kind of tokenizer allows it."""
        out, at = [], 0
        while self.long_by_parts and len(text) - at > SLICE_BYTES:
            found = _PART_END.search(text, at + SLICE_BYTES)
            if not found:
                break
            out.append(text[at : found.start() + 1])
            at = found.start() + 1
        return [*out, text[at:]]

    def _one(self, text: str) -> np.ndarray:
        """The ids of any text."""
        out, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            out += [self._slow(p) for p in self._parts(text[at : found.start()])]
            out.append(np.array([self.added[found.group()]], np.int32))
            at = found.end()
        out += [self._slow(p) for p in self._parts(text[at:])]
        return np.concatenate(out).astype(np.int32)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        if not self.by_classes:
            return [self._one(t) for t in texts]
        plain: list[int] = []
        group: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            if self.cut and self.cut.search(text):
                out[i] = self._one(text)
                continue
            parts = self._parts(text)
            if len(parts) > 1:
                out[i] = np.concatenate([self._plain([p])[0] for p in parts])
                continue
            plain.append(i)
            group.append(text)
            size += len(text)
            if size >= SLICE_BYTES:
                for k, ids in zip(plain, self._plain(group), strict=True):
                    out[k] = ids
                plain, group, size = [], [], 0
        for k, ids in zip(plain, self._plain(group), strict=True):
            out[k] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts without added tokens: all in one array, but for those with RARE characters."""
        if not texts:
            return []
        whole = " ".join(texts) + " "
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts])
        rare = np.flatnonzero(self.kind[np.minimum(points, 0x10000)] == RARE)
        if len(rare):
            odd = set(np.searchsorted(ends, rare, side="right").tolist())
            common = iter(self._plain([t for i, t in enumerate(texts) if i not in odd]))
            return [self._slow(t) if i in odd else next(common) for i, t in enumerate(texts)]
        known = self.words
        at, start = self._fast(points)
        counts = known.counts[at]
        ids = known.ids[spread(known.starts[at], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        cuts = before[np.searchsorted(start, ends)].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class Decoder:
    """Ids to text as the tokenizers library has it, special tokens included: without a decoder, tokens joined by a space; with
    a byte-level one, the bytes that tokens spell, where bytes that are no UTF-8 are replaced. Ids of no token are left out."""

    def __init__(self, path: str):
        told = encoder(path)
        names = {i: w for w, i in told.vocabulary.items()} | {i: w for w, i in told.added.items()}
        self.joined = told.decoder is None
        spelled = {s: b for b, s in enumerate(told.symbols)}

        def raw(name: str) -> bytes:
            if self.joined:
                return name.encode() + b" "
            return bytes(spelled[c] for c in name) if all(c in spelled for c in name) else name.encode()

        tokens = [raw(names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each span of ids."""
        inside = (ids >= 0) & (ids < len(self.lengths))
        lengths = np.where(inside, self.lengths[np.where(inside, ids, 0)], 0)
        raw = self.data[spread(self.starts[np.where(inside, ids, 0)], lengths)].tobytes()
        before = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        pieces = (raw[a:b] for a, b in zip(before[:-1], before[1:], strict=True))
        if self.joined:
            return [p[:-1].decode() for p in pieces]
        return [p.decode("utf-8", "replace") for p in pieces]


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer and Python worker; it lives from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def _others(df: DataFrame, column: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != column]


def _selected(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`") for f in _others(df, column)], F.col(f"`{column}`"))


def encode_texts(docs: DataFrame, tokenizer_path: str, *, text: str = "text", name: str = "ids") -> DataFrame:
    """docs without its text, and with name: the ids of the whole text as an array of int, without special tokens at its ends.

    A null or empty text has no ids. Strings of added tokens within a text become their ids, as in the library. Rows are
    independent: repeated rows, null keys and further columns stay as they are; where docs has a column of that name, the new
    one, which comes last, has an underscore more. Nothing is shuffled; a task holds the texts of an Arrow batch and encodes
    half a MB of them at a time, a longer text by parts.
    """
    others = _others(docs, text)
    name = fresh(docs.drop(text), name)
    schema = T.StructType([*others, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for rows, data, offsets in text_slices(batches, text, SLICE_BYTES):
            raw = data.tobytes()
            ids = encode.texts([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], [*rows.schema.names[:-1], name])

    return _selected(docs, text).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer_path: str, *, ids: str = "ids", name: str = "text") -> DataFrame:
    """encoded without its ids, and with name: the text that they stand for, special tokens included.

    Null and empty arrays are an empty text; null elements and ids of no token are left out. Other columns stay.
    """
    others = _others(encoded, ids)
    name = fresh(encoded.drop(ids), name)
    schema = T.StructType([*others, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer_path)
        for batch in batches:
            at = 0
            lists = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else ()
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + SLICE_IDS, side="right")))
                values = lists.slice(at, end - at).flatten().fill_null(-1).to_numpy()
                texts = decode.texts(values, np.concatenate([[0], sizes[at:end] - base]))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], name])
                at = end

    return _selected(encoded, ids).mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    """Ids as decimal numbers with one space between."""
    return F.array_join(ids.cast("array<string>"), " ")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of ids_text), decoded_sha256 of every row of docs(doc_id, text), which is encoded, then decoded."""
    encoded = encode_texts(docs.select("doc_id", "text"), tokenizer_path)
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"), "ids")
    decoded = decode_ids(told, tokenizer_path, name="decoded")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
