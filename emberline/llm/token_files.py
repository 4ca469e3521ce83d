"""Token-id output: documents encoded by a public tokenizer, each compressed alone with one dictionary that all share.

A set of files is a folder with `dictionary`, and one `shard-NNNNN-ATTEMPT.tok` for each range of doc_id, in ascending order:

    "TOKIDS01" | sha256 of the dictionary, 32 bytes | bytes of one id (2 or 4), 1 byte
    one zstandard frame for each document: its ids, little-endian, the end id included
    doc_id int64[n] | frame offset uint64[n + 1] | ids uint32[n]
    n uint64 | offset of the index uint64 | "TOKIDS01"

A reader takes the last 24 bytes, then the index, and can decode any one document by its offset.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import dictionary, dictionary_hash, open_input, open_output, shuffle_partitions, text_slices, work_path, written
from emberline.llm.shingles import prefix_hash, span_hash

MAGIC = b"TOKIDS01"
#: Texts that the dictionary is trained on are no longer than this.
SAMPLE_BYTES = 1 << 16
#: Texts that are encoded together.
SLICE_BYTES = 1 << 19
_PART_END = re.compile(rb"[A-Za-z] ")
NULL_ID = -(2**63)

#: Bytes of ASCII white space, of ASCII letters, and of all ASCII characters but letters.
_WHITE, _LETTER, _NO_LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER[:128] = [chr(b).isalpha() for b in range(128)]
_NO_LETTER[:128] = ~_LETTER[:128]
#: UTF-8 of the other white space, by its first byte.
_WIDE_WHITE = {lead: [c for c in (chr(x).encode() for x in range(0x80, 0x3001) if chr(x).isspace()) if c[0] == lead] for lead in (0xC2, 0xE1, 0xE2, 0xE3)}


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pieces of texts end to end, which bytes belong to Latin letters).

    A byte-level pre-tokenizer never joins what is cut here: white space begins a new pre-token, and of single
    white characters only the space goes with what follows; a word ends before any ASCII character that is no letter. Letters are those of ASCII and of U+00C0 to
    U+024F, which all versions of Unicode agree on; where others stand, a piece is longer than need be.
    """
    white, latin = _WHITE[data], _LETTER[data]
    for lead, spellings in _WIDE_WHITE.items():
        at = np.flatnonzero(data == lead)
        for c in spellings if len(at) else []:
            hit = at[at + len(c) <= len(data)]
            for k in range(1, len(c)):
                hit = hit[data[hit + k] == c[k]]
            for k in range(len(c)):
                white[hit + k] = True
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[lead + 1 < len(data)]
    lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
    latin[lead] = latin[lead + 1] = True
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = white[1:] & ~white[:-1]
    begin[1:-1] |= latin[:-1] & _NO_LETTER[data[1:]]
    begin[2:-1] |= _WHITE[data[1:-1]] & (data[1:-1] != 0x20) & ~white[2:] & ~white[:-2]
    begin[offsets] = True
    return np.flatnonzero(begin[:-1]), latin


class PieceEncoder:
    """tokenizers' encoding of whole texts by pieces; pieces met before are not encoded again.

    Pieces are cut where this kind of pre-tokenizer cuts, so their ids in a row are the text's; a tokenizer of another kind,
    and a text with an added token in it, is encoded as a whole. New words are encoded together in one call; as every id
    stands for a known number of bytes, the ids are dealt to their words by length.

    A piece is found by a hash of its bytes and compared with the bytes remembered; texts with unequal pieces of one hash are
    encoded as a whole. At most max_pieces and those of a slice are remembered, in arrays of some 60 bytes a piece; the half
    not met for the longest time goes. The worker keeps them between tasks.
    """

    def __init__(self, path: str, max_pieces: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        self.by_pieces = self._cuts_so(told)
        self.added = [t["content"].encode() for t in told["added_tokens"] if t["content"]]
        self.max_pieces, self.now = max_pieces, 0
        # Of remembered pieces in the order of their hashes: hash, slice it was last met in, place and length of its bytes and ids.
        self.hashes = np.zeros(0, np.uint64)
        self.met = np.zeros(0, np.int32)
        self.spans = np.zeros((0, 4), np.int32)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.dtype)
        if self.by_pieces:
            # A byte-level vocabulary spells a byte by one character.
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.id_bytes[list(vocabulary.values())] = [len(v) for v in vocabulary]

    @staticmethod
    def _cuts_so(told: dict) -> bool:
        pre, model = told["pre_tokenizer"] or {}, told["model"]
        plain = not any(told[k] for k in ("normalizer", "post_processor", "truncation", "padding")) and model["type"] == "BPE" and not model.get("dropout")
        return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, raw: bytes, offsets: np.ndarray) -> list[bytes]:
        return [x.tobytes() for x in self._whole([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])]

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, latin: np.ndarray) -> None:
        """Encode pieces, all of other hashes than those remembered, and remember them."""
        letters = np.concatenate([[0], np.cumsum(latin)])
        word = (data[starts] == 0x20) & (lengths > 1) & (letters[starts + lengths] - letters[starts + 1 - (lengths == 1)] == lengths - 1)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        starts, lengths, hashes, n_words = starts[order], lengths[order], hashes[order], int(word.sum())
        own = data[spread(starts, lengths)]
        ends = np.cumsum(lengths)
        cut = int(ends[n_words - 1]) if n_words else 0
        rest = own[cut:].tobytes()
        others = self._whole([rest[b - n - cut : b - cut].decode() for b, n in zip(ends[n_words:].tolist(), lengths[n_words:].tolist(), strict=True)])
        counts = np.zeros(len(starts), np.int64)
        counts[n_words:] = [len(x) for x in others]
        ids = np.zeros(0, self.dtype)
        if n_words:
            ids = self._whole([own[:cut].tobytes().decode()])[0]
            last = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends[:n_words]) + 1
            counts[:n_words] = np.diff(last, prepend=0)
        spans = np.stack([len(self.bytes) + ends - lengths, lengths, len(self.ids) + np.cumsum(counts) - counts, counts], axis=1).astype(np.int32)
        self.bytes, self.ids = np.concatenate([self.bytes, own]), np.concatenate([self.ids, ids, *others])
        sort = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[sort])
        self.hashes = np.insert(self.hashes, place, hashes[sort])
        self.spans = np.insert(self.spans, place, spans[sort], axis=0)
        self.met = np.insert(self.met, place, self.now)

    def _forget(self) -> None:
        keep = self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]
        self.hashes, self.met, spans = self.hashes[keep], self.met[keep], self.spans[keep].astype(np.int64)
        self.bytes, self.ids = self.bytes[spread(spans[:, 0], spans[:, 1])], self.ids[spread(spans[:, 2], spans[:, 3])]
        for c in (1, 3):
            spans[:, c - 1] = np.cumsum(spans[:, c]) - spans[:, c]
        self.spans = spans.astype(np.int32)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Of texts without added tokens."""
        if not len(data):
            return [b""] * (len(offsets) - 1)
        self.now += 1
        if len(self.hashes) > self.max_pieces:
            self._forget()
        starts, latin = pieces(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        hashes = span_hash(prefix_hash(data), starts, starts + lengths) + lengths.astype(np.uint64)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != unique if len(self.hashes) else np.ones(len(unique), bool)
        if new.any():
            self._learn(data, starts[first[new]], lengths[first[new]], unique[new], latin)
            at = np.searchsorted(self.hashes, unique)
        self.met[at] = self.now
        spans = self.spans[at].astype(np.int64)[which]
        if (spans[:, 1] != lengths).any() or (self.bytes[spread(spans[:, 0], lengths)] != data).any():  # unequal pieces of equal hash
            return self._each(data.tobytes(), offsets)
        packed, size = self.ids[spread(spans[:, 2], spans[:, 3])].tobytes(), self.dtype.itemsize
        before = np.concatenate([[0], np.cumsum(spans[:, 3])])
        cuts = (before[np.searchsorted(starts, offsets)] * size).tolist()
        return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of texts, given by their UTF-8 end to end, packed in dtype. A long text goes by parts of some MB."""
        raw = data.tobytes()
        if not self.by_pieces or any(t in raw for t in self.added):
            return self._each(raw, offsets)
        if len(data) <= 2 * SLICE_BYTES:
            return self._slice(data, offsets)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts = []
            while a < b:
                # a space after an ASCII letter begins a piece
                found = _PART_END.search(raw, a + SLICE_BYTES, b) if b - a > SLICE_BYTES else None
                end = found.start() + 1 if found else b
                parts += self._slice(data[a:end], np.array([0, end - a]))
                a = end
            out.append(b"".join(parts))
        return out

    def __call__(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.texts(raw, np.array([0, len(raw)]))[0]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each tokenizer and Python worker; it lives from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class ShardWriter:
    def __init__(self, stream, content: bytes, dtype: np.dtype, level: int = 3):
        self.stream, self.dtype = stream, dtype
        self.coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdCompressor(level=level)
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        head = MAGIC + dictionary_hash(content) + bytes([dtype.itemsize])
        stream.write(head)
        self.offsets = [len(head)]

    def add(self, doc_id: int, packed: bytes) -> None:
        frame = self.coder.compress(packed)
        self.stream.write(frame)
        self.doc_ids.append(doc_id)
        self.counts.append(len(packed) // self.dtype.itemsize)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> None:
        for values, kind in ((self.doc_ids, "<i8"), (self.offsets, "<u8"), (self.counts, "<u4")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(np.array([len(self.doc_ids), self.offsets[-1]], "<u8").tobytes() + MAGIC)
        self.stream.close()


class ShardReader:
    """Any document of a shard by its place, or all in a row; only the index is held."""

    def __init__(self, stream, content: bytes):
        size = stream.size() if hasattr(stream, "size") and callable(stream.size) else stream.getbuffer().nbytes
        stream.seek(0)
        head = stream.read(41)
        if head[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        if head[8:40] != dictionary_hash(content):
            raise ValueError("the shard was written with another dictionary")
        stream.seek(size - 24)
        tail = stream.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("the shard's index is cut off")
        n, at = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
        stream.seek(at)
        index = stream.read(size - 24 - at)
        if len(index) != 20 * n + 8:
            raise ValueError("the shard's index has another length than its count of documents says")
        self.stream, self.dtype = stream, np.dtype(f"<u{head[40]}")
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 16 * n + 8)
        self.decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        self.stream.seek(int(self.offsets[i]))
        packed = self.decoder.decompress(self.stream.read(int(self.offsets[i + 1] - self.offsets[i])))
        ids = np.frombuffer(packed, self.dtype)
        if len(ids) != self.counts[i]:
            raise ValueError(f"document {self.doc_ids[i]} has {len(ids)} ids, its index says {self.counts[i]}")
        return ids.astype("<u4")


def train_id_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, sample_docs: int, dictionary_bytes: int) -> bytes:
    """A dictionary for packed ids, from the sample_docs documents whose hashed ids come first; empty for an empty table.

    Long ones among them, over 64 KB, gain nothing from a dictionary and are left out, so the sample is bounded in bytes.
    """
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    short = F.octet_length("text") <= SAMPLE_BYTES
    rows = docs.join(F.broadcast(chosen), "doc_id").where(short).select("text").limit(2 * sample_docs).collect()
    encode = encoder(tokenizer_path)
    end = encode._pack([end_id])
    samples = [encode(r["text"]) + end for r in rows]
    return dictionary(samples, dictionary_bytes).as_bytes() if samples else b""


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, path: str | None = None, order: str = "doc_id", shards: int | None = None, sample_docs: int = 256, dictionary_bytes: int = 65_536) -> DataFrame:
    """Write docs(doc_id, text) as token-id files below path, one for each range of the order column; return the manifest.

    The manifest has a row for each shard: path, shard, n_docs, n_ids, first_order, start (the ids of all shards before
    it), dictionary and ordered_by. Documents stand in ascending order; equal values in the order of doc_id and text. A null text has the end id only; a
    null doc_id counts as the smallest one. Texts are shuffled once, into ranges; ids never are. shards follows
    spark.sql.shuffle.partitions. A task that runs again writes another file: the manifest, which Spark commits, names the one
    that counts, and a file that it doesn't name is left over from a lost attempt.
    """
    spark = docs.sparkSession
    root = path or work_path(spark, "token-files")
    content = train_id_dictionary(docs, tokenizer_path, end_id, sample_docs, dictionary_bytes)
    with open_output(f"{root}/dictionary") as out:
        out.write(content)
    rows = docs.select(F.coalesce(F.col(order), F.lit(NULL_ID)).alias("place"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.repartitionByRange(shards or shuffle_partitions(spark), "place").sortWithinPartitions("place", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        final = f"{root}/shard-{shard:05d}-{task.taskAttemptId()}.tok"
        encode, writer, first = encoder(tokenizer_path), None, None
        end = encode._pack([end_id])
        for batch in batches:
            if writer is None and batch.num_rows:
                first, writer = batch.column(0)[0].as_py(), ShardWriter(open_output(final), content, encode.dtype)
            for rows, data, offsets in text_slices(iter([batch]), "text", SLICE_BYTES):
                for doc_id, ids in zip(rows.column(1).to_pylist(), encode.texts(data, offsets), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [final], "shard": [shard], "n_docs": [len(writer.doc_ids)], "n_ids": [sum(writer.counts)], "first_order": [first]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_order", pa.int64())])
    manifest = written(ranges.mapInArrow(run, "path string, shard int, n_docs long, n_ids long, first_order long"), "token-manifest")
    # One row for each shard, however many documents there are.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("dictionary", F.lit(f"{root}/dictionary")).withColumn("ordered_by", F.lit(order))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_bytes (of its frame) for every document of the manifest's files.

    Every frame is decoded; dictionary hash, index and counts are checked, and a mismatch fails the job.
    """
    n = shuffle_partitions(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents: dict[str, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] not in contents:
                    with open_input(row["dictionary"]) as stream:
                        contents[row["dictionary"]] = stream.read()
                with open_input(row["path"]) as stream:
                    shard = ShardReader(stream, contents[row["dictionary"]])
                    starts = row["start"] + np.concatenate([[0], np.cumsum(shard.counts, dtype=np.int64)])[:-1]
                    crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(len(shard))]
                    doc_ids = pa.array([None if d == NULL_ID else d for d in shard.doc_ids.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.diff(shard.offsets).astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"])

    return manifest.select("path", "start", "dictionary", "shard").repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long")


def read_document(spark: SparkSession, manifest: DataFrame, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id. Only shards that can hold it are opened, if files are in the order of doc_id (else all
    are), and of them only the index and its own frames are read."""
    after = F.lead("first_order").over(Window.orderBy("shard"))
    within = (F.col("first_order") <= doc_id) & (F.col("after").isNull() | (F.col("after") >= doc_id))
    rows = manifest.withColumn("after", after).where((F.col("ordered_by") != "doc_id") | within)
    found = []
    for row in rows.orderBy("shard").toLocalIterator():
        with open_input(row["dictionary"]) as stream:
            content = stream.read()
        with open_input(row["path"]) as stream:
            shard = ShardReader(stream, content)
            found += [shard.ids(int(i)).tolist() for i in np.flatnonzero(shard.doc_ids == doc_id)]
    return found


def shard_bytes(documents: list[tuple[int, bytes]], content: bytes, dtype: str = "<u2") -> bytes:
    """A shard in memory, as small tools and tests want it."""

    class Kept(io.BytesIO):
        def close(self) -> None:
            pass

    out = Kept()
    writer = ShardWriter(out, content, np.dtype(dtype))
    for doc_id, packed in documents:
        writer.add(doc_id, packed)
    writer.close()
    return out.getvalue()
