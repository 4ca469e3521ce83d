import hashlib
import random

import numpy as np
import pytest

from emberline.llm import infill
from emberline.llm.infill import MARKERS, check_markers, digests, fill_in_middle, restored

TEXTS = [None, "", "a", "ab", "é😀\x00漢 x", "has <P> in it", "<S>", "x<M", "<", "<P", "S><M", " \n\n a  b\n", "word " * 50, "line one\nline two\r\n\nend", " 　x"]


def units(text, unit):
    """Units by a loop over characters."""
    out = []
    for i, c in enumerate(text):
        new = not out or unit == "character"
        if out and unit == "line":
            new = out[-1].endswith("\n")
        if out and unit == "word":
            new = out[-1][-1].isspace() and not c.isspace()
        if new:
            out.append(c)
        else:
            out[-1] += c
    assert "".join(out) == text
    return out


def plain(doc_id, text, unit="character", seed=1, keep=90, spm=20, markers=MARKERS):
    text = text or ""
    parts, (p, s, m) = units(text, unit), markers
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(parts)
    if not text or any(x in text for x in markers) or h3 % 100 >= keep:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("unit", infill.UNITS)
@pytest.mark.parametrize(("keep", "spm", "markers"), [(90, 20, MARKERS), (100, 50, ("<|a|>", "<|b|>", "[m]."))])
def test_equals_a_loop_and_comes_back(spark, unit, keep, spm, markers):
    draw = random.Random(2)
    texts = TEXTS + ["".join(draw.choice("ab <PSM>\n 　é") for _ in range(draw.randint(0, 30))) for _ in range(400)]
    pairs = [(None if i % 50 == 49 else i, t) for i, t in enumerate(texts)]
    rows = fill_in_middle(spark.createDataFrame(pairs, "doc_id long, text string"), unit=unit, keep_percent=keep, spm_percent=spm, markers=markers)
    rows = rows.withColumn("back", restored(rows["output"], rows["form"], markers)).collect()
    want = [plain(i, t, unit, 1, keep, spm, markers) for i, t in pairs]
    assert [tuple(r)[:-1] for r in rows] == want and [r.back for r in rows] == [t or "" for t in texts]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_columns_repeated_rows_and_no_rows(spark, make_docs):
    rows = digests(make_docs([(4, "same text"), (4, "same text"), (5, None)]).withColumnRenamed("label", "form"))
    assert rows.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    found = sorted(tuple(r) for r in rows.select("doc_id", "restored_sha256").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == [(4, sha("same text")), (4, sha("same text")), (5, sha(""))]
    assert digests(make_docs([])).count() == 0


def test_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(infill, "SLICE_BYTES", 1000)
    text = "long é text\n" * 300_000
    rows = fill_in_middle(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), keep_percent=100)
    rows = rows.withColumn("back", restored(rows["output"], rows["form"])).collect()
    assert [r.back == t for r, t in zip(rows, (text, "b"), strict=True)] == [True, True] and rows[0].n == len(text)


def test_markers_that_can_be_mistaken():
    for bad in (("", "b", "c"), ("aa", "b", "c"), ("ab", "bc", "d"), ("a", "xax", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            check_markers(bad)
    check_markers(MARKERS)
    with pytest.raises(ValueError):
        fill_in_middle(None, unit="page")


def test_boundaries():
    points = np.frombuffer("a b\n c".encode("utf-32-le"), "<u4")
    assert [infill.boundaries(points, u).tolist() for u in infill.UNITS] == [[0, 1, 2, 3, 4, 5, 6], [0, 2, 5, 6], [0, 4, 6]]
    assert infill.boundaries(points[:0], "word").tolist() == [0]
