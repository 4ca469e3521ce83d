import hashlib
import random

import numpy as np
import pytest

from emberline.llm import suffixes as sx


def brute(rows, length):
    """{(doc_id, text): (n_bytes, spans, kept)}; rows in the order of doc_id, then digest."""
    docs = sorted({(sx.NULL_ID if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(raw[s : s + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out[i, t] = (len(raw), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.choice([length - 1, length, length + 1, 3 * length]))) for _ in range(6)]
    lines = ["the common line of all. ", "x" * 20]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.35:
                p = rng.choice(passages)
                if rng.random() < 0.3:
                    at = rng.randrange(len(p))
                    p = p[:at] + "#" + p[at + 1 :]
                parts.append(p)
            elif kind < 0.6:
                parts.append(rng.choice(lines) * rng.choice([1, 1, 9]))
            else:
                parts.append("".join(rng.choice("abcdefgh é日") for _ in range(rng.randint(1, 90))))
        rows.append((rng.choice([i, i, i, 7]), "".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "q" * (4 * length)), (503, None), (504, ""), (None, rows[5][1] + "tail"), (3, rows[3][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "length", "slice_bytes", "group_rows"), [(1, 100, 1 << 20, 20000), (2, 64, 700, 20000), (3, 100, 3000, 2)])
def test_equals_brute_force(make_docs, seed, length, slice_bytes, group_rows):
    rows = corpus(seed, length)
    docs = make_docs(rows).repartition(6)
    truth = brute(rows, length)
    out = sx.removed(docs, length, slice_bytes, group_rows).collect()
    assert len(out) == len(rows)
    got = sorted((sx.NULL_ID if r.doc_id is None else r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in out)
    ids = [(sx.NULL_ID if i is None else i, t or "") for i, t in rows]
    want = sorted((i, truth[i, t][0], tuple(truth[i, t][1]), truth[i, t][2]) for i, t in ids)
    assert got == want


def test_digests_and_empty(spark, make_docs):
    text = "z" * 250
    out = {r.doc_id: r for r in sx.digests(make_docs([(1, text), (2, "abc"), (3, "abc")])).collect()}
    assert (out[1].n_bytes, out[1].n_removed, out[1].n_spans) == (250, 249, 1)
    assert out[1].kept_sha256 == hashlib.sha256(b"z").hexdigest()
    assert out[2].n_removed == out[3].n_removed == 0
    assert sx.digests(make_docs([(1, "a")]).limit(0)).count() == 0


def test_long_text_in_pieces(make_docs):
    rng = random.Random(9)
    piece = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(1, piece + "".join(rng.choice("efgh") for _ in range(2500)) + piece), (2, "x" + piece[500:900])]
    truth = brute(rows, 100)
    for r in sx.removed(make_docs(rows), 100, slice_bytes=1000).collect():
        assert bytes(r.kept) == truth[r.doc_id, dict(rows)[r.doc_id]][2]


def test_blind_trie_groups_equal_strings():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    trie = sx.BlindTrie()
    for i, t in enumerate(texts):
        trie.insert(t, i)
    groups = list(trie.groups())
    assert sorted(i for g in groups for i in g) == list(range(300))
    assert [texts[g[0]] for g in groups] == sorted(set(texts))
    assert all({texts[i] for i in g} == {texts[g[0]]} for g in groups)


def test_hashes_of_whole_runs_tell_strings_apart_and_not_places():
    """Strings of which powers modulo 2**64 have equal sums at any base."""
    from emberline.llm.shingles import prime_hash

    thue, other = b"a", b"b"
    for _ in range(11):
        thue, other = thue + other, other + thue
    data = np.frombuffer(b"xy" + thue + b"z" + other + thue, np.uint8)
    n = len(thue)
    h = prime_hash(data, np.array([2, 3 + n, 3 + 2 * n]), np.array([2 + n, 3 + 2 * n, 3 + 3 * n]))
    assert h[0] == h[2] != h[1]
    assert h[0] == prime_hash(np.frombuffer(thue, np.uint8), np.array([0]), np.array([n]))[0]
