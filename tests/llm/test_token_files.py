import io
import random
import zlib

import numpy as np
import pytest

from emberline.llm import token_files
from emberline.llm.queries import tokenizer_path
from emberline.llm.token_files import PieceEncoder, ShardReader, read_document, read_token_files, shard_bytes, write_token_files

ODD = ["", " ", "  two  spaces ", "a\nb \n c\t d", "don't  they're 'S", "naïve façade, große Straße!", "x&&& y$$$ 12,5 ", "<|endoftext|> and <|endoftext|>", "日本語 テキスト", "a b  c", "it's", "word.,;!", "\x1f a\x1fb \x85 c", "é combining"]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_equal_the_whole_text():
    rng = random.Random(1)
    alphabet = ["a", "The", " ", " ", "  ", "\n", ",", "'s", "é", "9", "!!", "\t", "ß", "$", " ", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    encode = PieceEncoder(tokenizer_path(), max_pieces=50)
    assert encode.by_pieces
    assert [np.frombuffer(encode(t), encode.dtype).tolist() for t in texts] == reference(texts)


def test_pieces_of_many_scripts_and_spaces(monkeypatch):
    rng = random.Random(2)
    alphabet = ["a", "The", " ", " ", "\u00a0", "\u0085", "\u2003", "\u3000", "\u1680", "\u202f", "\x1c", "\x0b", "\x0c", "\r\n", "é", "ǆ", "ɏ", "×", "÷", "ª", "я", "β", "日", "\u0301", "'s", "’s", "1", "²", "_", "—", "🙂", "x,"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encode = PieceEncoder(tokenizer_path(), max_pieces=300)
    expected = [np.array(ids, encode.dtype).tobytes() for ids in reference(texts)]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert encode.texts(np.frombuffer(raw, np.uint8), offsets) == expected
    # a long text goes by parts, and hashes that are equal for unequal pieces change nothing
    monkeypatch.setattr(token_files, "SLICE_BYTES", 64)
    long = " ".join(texts)
    assert encode(long) == np.array(reference([long])[0], encode.dtype).tobytes()
    monkeypatch.setattr(token_files, "span_hash", lambda h, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    encode = PieceEncoder(tokenizer_path())
    assert [encode(t) for t in texts[:200]] == expected[:200]


def test_another_kind_of_tokenizer_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_file(tokenizer_path())
    t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "lower.json"))
    encode = PieceEncoder(str(tmp_path / "lower.json"))
    assert not encode.by_pieces
    assert np.frombuffer(encode("Some TEXT"), encode.dtype).tolist() == t.encode("Some TEXT").ids


def test_round_trip_and_starts(spark, make_docs, monkeypatch):
    texts = ODD + [None, "long " * 30000, "same", "same"]
    docs = make_docs([*enumerate(texts), (5, "repeated id"), (5, "repeated id"), (None, "no id")])
    manifest = write_token_files(docs, tokenizer_path(), shards=4)
    out = read_token_files(manifest).toPandas()
    assert len(out) == docs.count()
    rows = sorted([(token_files.NULL_ID if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()])
    start, expected = 0, []
    for (i, _), ids in zip(rows, reference([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = [(token_files.NULL_ID if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()]
    assert sorted(out) == sorted(expected)
    opened = []
    monkeypatch.setattr(token_files, "open_input", lambda uri, was=token_files.open_input: opened.append(uri) or was(uri))
    assert read_document(spark, manifest, 10**9) == [] and len(opened) <= 2
    assert read_document(spark, manifest, 13) == [[*reference([ODD[13]])[0], 2]]


def test_empty_table(make_docs):
    assert read_token_files(write_token_files(make_docs([(1, "a")]).limit(0), tokenizer_path())).count() == 0


def test_a_reader_refuses_damage():
    raw = shard_bytes([(7, np.array([1, 2, 3], "<u2").tobytes())], b"")
    assert ShardReader(io.BytesIO(raw), b"").ids(0).tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(raw), b"another dictionary")
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(raw[:-3]), b"")
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(b"x" + raw), b"")
