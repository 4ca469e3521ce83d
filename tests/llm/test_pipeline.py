import random
import zlib

import numpy as np
import pytest
from brute import near_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    sf = str(tmp_path_factory.mktemp("sf"))
    syllables = ["ba", "ke", "ti", "mo", "ru", "sha", "lo", "vi"]
    words = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(15, 40)))) for i in range(8)]
    docs, labels = [], []
    for i in range(240):
        text = words(rng.randint(30, 150))
        if i % 12 == 0:
            text[5:5] = items[i % 8][1].split()
        bad = i % 7 == 3
        text = " ".join(w.upper() + "!!" for w in text) if bad else " ".join(text)
        if i % 9 == 4:
            text = docs[i - 3][1] + (" more" if i % 2 else "")
            bad = (i - 3) % 7 == 3
        docs.append((i, text, "en", f"src{0 if i % 3 else i % 5}", len(text)))
        labels.append((i, int(not bad), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, labels, items


def test_every_stage_against_plain_versions(spark, tables):
    from emberline.llm.mixing import mix
    from emberline.llm.queries import tokenizer_path
    from emberline.llm.token_files import PieceEncoder

    sf, docs, labels, items = tables
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r[0]: r for r in docs}
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf}/out-{name}"
        stage(spark, frame, sf).write.parquet(path)
        frame = outs[name] = spark.read.parquet(path)
        if name != "token_files":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    ids = {r.doc_id for r in outs["quality"].collect()}
    good = {i for i, q, _ in labels if q}
    assert len(ids ^ good) <= 0.03 * len(docs)

    near = near_components([(i, kept[i][1]) for i in sorted(ids)], 5, 80)
    ids = {i for i, (_, c) in near.items() if c == i}
    assert {r.doc_id for r in outs["near_duplicates"].collect()} == ids

    ids = {i for i in ids if not any(b in kept[i][1] for _, b in items)}
    assert {r.doc_id for r in outs["decontamination"].collect()} == ids

    order = [r.doc_id for r in mix(outs["decontamination"]).orderBy("mix_place").collect()]
    assert set(order) == ids
    assert [r.doc_id for r in outs["mixing"].orderBy("_metadata.file_name", "_metadata.row_index").collect()] == order

    encode, start, want = PieceEncoder(tokenizer_path()), 0, []
    for i in order:
        tokens = np.append(np.frombuffer(encode(kept[i][1]), encode.dtype), 2).astype("<u4")
        want.append((i, start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in outs["token_files"].orderBy("start").collect()]
    assert got == want

    again = corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in again] == want


def test_nulls_empty_tables_and_clashing_columns(spark, tables, tmp_path):
    sf, docs, _, _ = tables
    more = [(None, "no id " * 30, None, None, None), (9001, None, "en", None, 0), (9002, "", "en", "src0", 0), (None, None, None, None, None), docs[2], docs[2]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = ["key", "label", "near_rank", "leak_key", "mix_place", "file_place", "row", "mix_source"]
    frame = spark.createDataFrame([*docs[:60], *more], schema).selectExpr("*", *[f"CONCAT('{n}', doc_id) AS {n}" for n in names])
    for rows in (frame, frame.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{rows is frame}-{name}"
            stage(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
            if name != "token_files":
                assert now.columns == rows.columns
                for r in now.collect():
                    assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)
        found = now.collect()
        assert len(found) == len({r.start for r in found}) and (rows is frame or not found)
    assert len(found) == 0 and now.count() == 0
