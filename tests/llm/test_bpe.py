"""Encoding and decoding against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import pytest

from emberline.llm import bpe
from emberline.llm.queries import WORD_TOKENIZER, op11_bpe, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "it's 'S 's's ''s x'llo 'rex 'r 've!! don't", "É é İstanbul ΣΑΣ ſ K 漢字かな １２ ½ a b c \u0085 é 한국어 😀👍🏽 x", "a" * 3000, "aaaa aaa", "'", "1'st", "\x00\x01", "ƧƐ ǄǅẞΩÅ豈ͅᾳ", "a b ​c"]
ADDED = ["x<|endoftext|>'t a", "<|startoftext|><|endoftext|>", "<|endoftext|><|startoftext|", "'s<|endoftext|>'s  <|ENDOFTEXT|>"]


@pytest.fixture(scope="module", params=[WORD_TOKENIZER, "byte_bpe_50k.json"])
def both(request):
    from tokenizers import Tokenizer

    path = tokenizer_path(request.param)
    return bpe.Encoder(path), Tokenizer.from_file(path)


def same(both, texts):
    ours, library = both
    for text, got, want in zip(texts, ours.texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, text[:100]


def test_odd_texts(both):
    same(both, ODD + ADDED)
    for text in ODD + ADDED:
        same(both, [text])


def test_random_texts(both):
    draw = random.Random(3)
    letters = "aAbsStTmMdlLrReEvV'’\"!?. \n\t\r 123½éÉßñΣσςİí̀한漢かx<|>endoftext​‍😀"
    same(both, ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)])
    same(both, ["".join(chr(draw.choice([draw.randrange(0x20, 0x250), draw.randrange(0x20, 0x3100), draw.randrange(0xE000, 0x1FFFF)])) for _ in range(draw.randint(0, 40))) for _ in range(3000)])


def test_every_character_of_the_tables_beside_letters_and_apostrophes(both):
    same(both, [f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}s" for a, b in bpe.TABLE_RANGES[:3] for c in range(a, b)])


def test_long_texts_go_by_parts_and_long_words_are_merged(both, monkeypatch):
    draw = random.Random(5)
    word = "".join(draw.choice("abcdefgh") for _ in range(20_000))
    texts = ["Some words, it's said  here\n" * 300, word, "é " * 500]
    same(both, texts)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 100)
    same(both, texts + ODD)


def test_forgetting_words_changes_nothing():
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_TOKENIZER)
    few = bpe.Encoder(path, max_words=3), Tokenizer.from_file(path)
    for text in ODD * 2:
        same(few, [text, "other words here to remember " + text])
    assert len(few[0].words.place) < 30


def plain_merges(word, ranks):
    while len(word) > 1:
        rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(word, word[1:], strict=False)))
        if rank == 1 << 60:
            break
        word = [*word[:at], word[at] + word[at + 1], *word[at + 2 :]]
    return word


@pytest.mark.parametrize("rising", [True, False])
def test_merge_rounds_against_one_merge_at_a_time(rising):
    """Also of merges in an order in which a merge makes a pair of lower rank."""
    draw = random.Random(7)
    for _ in range(30):
        names, merges = list("abc"), []
        for _ in range(12):
            pair = (draw.choice(names), draw.choice(names))
            if pair not in merges and pair[0] + pair[1] not in names:
                merges.append(pair)
                names.append(pair[0] + pair[1])
        if not rising:
            draw.shuffle(merges)
        ids = {n: i for i, n in enumerate(names)}
        table = bpe.MergeTable(merges, ids)
        words = ["".join(draw.choice("aabc") for _ in range(draw.randint(1, 15))) for _ in range(40)]
        got, counts = table.merged(np.array([ids[c] for w in words for c in w]), np.array([len(w) for w in words]))
        want = [plain_merges(list(w), {m: r for r, m in enumerate(merges)}) for w in words]
        assert table.rising or not rising
        assert counts.tolist() == [len(w) for w in want] and got.tolist() == [ids[s] for w in want for s in w]


def test_decoding(both):
    ours, library = both
    decode = bpe.Decoder.__new__(bpe.Decoder)
    bpe._encoders["under test"] = ours
    decode.__init__("under test")
    draw = random.Random(11)
    size = library.get_vocab_size()
    lists = [[], [size - 1], *[[draw.randrange(size) for _ in range(draw.randint(1, 30))] for _ in range(300)], [3, 10**6, 5]]
    flat, ends = np.array([i for x in lists for i in x]), np.cumsum([len(x) for x in lists])
    assert decode.texts(flat, np.append(0, ends)) == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"a": 0}, unk_token="a")).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "t.json"))


def test_frames(spark, make_docs):
    """Nulls, empty texts, repeated rows, no rows, and columns with names that are wanted."""
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_TOKENIZER)
    library = Tokenizer.from_file(path)
    pairs = [(1, "one two"), (2, None), (3, ""), (None, "null's id"), (1, "one two"), (5, ODD[3] + ADDED[0])]
    docs = make_docs(pairs).withColumnRenamed("label", "ids")
    rows = bpe.encode_texts(docs, path)
    assert rows.columns == [*[c for c in docs.columns if c != "text"], "ids_"]
    back = bpe.decode_ids(rows, path, ids="ids_", name="lang")
    assert back.columns[-1] == "lang_" and "ids" in back.columns
    got = sorted(((r.doc_id or 0, r["lang_"]) for r in back.collect()))
    assert got == sorted((i or 0, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in pairs)
    lists = spark.createDataFrame([(1, None), (2, [320, None, -1, 49407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(lists, path).collect()} == {1: "", 2: library.decode([320, 49407], skip_special_tokens=False)}
    assert bpe.digests(make_docs([]), path).count() == 0


def test_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in op11_bpe(spark, SF).collect()} == want
