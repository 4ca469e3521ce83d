import random

import numpy as np

from emberline.llm import decontamination as dc
from emberline.llm.decontamination import Settings, answer_share, common_subsequence, decontaminate, find_leaks, hashed, places

RNG = random.Random(7)
COMMON = ["the", "of", "and", "is", "to", "in"]


def words(n):
    return [RNG.choice(COMMON) if RNG.random() < 0.45 else "".join(RNG.choice(["ba", "ke", "ti", "mo", "ru", "sha"]) for _ in range(RNG.randint(2, 4))) for _ in range(n)]


def setting():
    items = [(i, " ".join(words(RNG.randint(14, 60))) + ". " + " ".join(words(5)) + ".") for i in range(30)]
    docs, truth = [], set()
    for i in range(200):
        text = words(RNG.randint(0, 400))
        if i % 5 == 0:
            item, body = items[i % 30]
            leak = body.split()
            if i % 10 == 0:
                leak = [w.upper() + "," for w in leak]
            elif i % 15 == 0:  # a paraphrase: some words replaced, the end kept
                leak = [w if RNG.random() < 0.85 or k > len(leak) - 8 else "other" + w for k, w in enumerate(leak)]
            at = RNG.randint(0, len(text))
            text[at:at] = leak
            truth.add((i, item))
        docs.append((i, " ".join(text)))
    return docs, items, truth


def test_leaks_are_found_and_clean_documents_left(spark, make_docs):
    docs, items, truth = setting()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(make_docs(docs).repartition(4), benchmark).collect()}
    assert found == truth
    kept = decontaminate(make_docs(docs), benchmark)
    assert kept.columns == make_docs(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in truth}


def test_answers_decide_paraphrases(spark, make_docs):
    item = words(40)
    answer = ["xenon", "argon"]
    half = [w if k % 5 < 3 else f"swap{k}" for k, w in enumerate(item)]
    docs = make_docs([(1, " ".join(words(60) + half + answer + words(60))), (2, " ".join(words(60) + half + words(60))), *[(k, " ".join(words(200))) for k in range(3, 40)]])
    benchmark = spark.createDataFrame([(9, " ".join(item), "Xenon, argon")], "item_id long, text string, answer string")
    out = find_leaks(docs, benchmark, Settings(cosine=0.3)).collect()
    assert [(r.doc_id, r.item_id, r.answer_coverage) for r in out] == [(1, 9, 1.0)]


def test_case_of_all_alphabets_and_scattered_answers(spark, make_docs):
    item = [f"é{w}ц" for w in words(30)]
    docs = make_docs([(1, " ".join(item).upper()), *[(k, " ".join(words(100))) for k in range(2, 30)]])
    assert [(r.doc_id, r.coverage) for r in find_leaks(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()] == [(1, 1.0)]
    masks = places(hashed("a b c d"))
    assert answer_share(masks, 4, hashed("x a b c d x").tolist(), 1.5) == 1.0
    assert answer_share(masks, 4, hashed("a x x x x x x x b x x x x x x x c x x x x x x d").tolist(), 1.5) == 0.5
    assert answer_share({}, 0, hashed("a b").tolist(), 1.5) == 0.0 == answer_share(masks, 4, [], 1.5)


def test_nulls_repeats_long_and_empty(spark, make_docs):
    item = " ".join(words(30))
    docs = make_docs([(1, None), (2, ""), (3, item), (3, item), (None, item), (4, " ".join(words(50000)) + " " + item)])
    benchmark = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, "x y z"), (10, " ".join(words(900)))], "item_id long, text string")
    out = [(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()]
    assert sorted(out, key=str) == sorted([(3, 7), (3, 7), (None, 7), (4, 7)], key=str)
    assert [r.doc_id for r in decontaminate(docs, benchmark).orderBy("doc_id").collect()] == [1, 2]
    assert find_leaks(docs.limit(0), benchmark).count() == 0
    assert find_leaks(docs, benchmark.limit(0)).count() == 0


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        ha, hb = hashed(" ".join(a)), hashed(" ".join(b))
        assert common_subsequence(places(ha), len(a), hb.tolist()) == table[-1][-1]


def test_passes_and_vectors_change_nothing(spark, make_docs, monkeypatch):
    docs, items, truth = setting()
    benchmark = spark.createDataFrame([(f"item {i}", t) for i, t in items], "item_id string, text string")
    rows = lambda settings: sorted(tuple(r) for r in find_leaks(make_docs(docs).repartition(3), benchmark, settings).collect())
    whole = rows(Settings())
    assert {(r[0], r[1]) for r in whole} == {(i, f"item {k}") for i, k in truth}
    assert rows(Settings(pass_words=100)) == whole
    kept = decontaminate(make_docs(docs), benchmark, Settings(pass_words=100))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in truth}
    # beyond so many cells of terms and items, scores come from vectors
    what = list(dc.searches(make_docs(docs), benchmark, Settings()))
    raw = [t.encode() for _, t in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    by_pull = dc.Searcher(*what[0], Settings())(data, offsets)
    monkeypatch.setattr(dc, "PULL_CELLS", 5000)
    by_vectors = dc.Searcher(*what[0], Settings())
    assert by_vectors.pull is None and by_vectors(data, offsets) == by_pull != {}


def test_many_rows_of_one_item(spark, make_docs):
    texts = [" ".join(words(12)) for _ in range(3000)]
    docs = make_docs([(i, " ".join(words(40)) + " " + texts[i * 37] + " " + " ".join(words(40))) for i in range(80)] + [(100 + i, " ".join(words(90))) for i in range(80)])
    benchmark = spark.createDataFrame([(5, t) for t in texts], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark, Settings(pass_words=500)).collect()}
    assert {(i, 5) for i in range(80)} <= found
    assert all(r[1] == 5 for r in found)


def test_retrieval_against_all_pairs(spark, make_docs):
    """Paraphrases with 10 to 45 of 100 words replaced: what the checks accept is retrieved, and nothing else is found."""
    rng = random.Random(11)
    items = [(i, " ".join(words(rng.randint(16, 46)))) for i in range(60)]
    docs = []
    for i in range(240):
        leak = [w if rng.random() > 0.1 + 0.35 * (i % 4) / 3 else "z" + w for w in items[i % 60][1].split()]
        before = words(rng.randint(0, 120))
        docs.append((i, " ".join(before + leak + words(rng.randint(0, 120)))))
    settings = Settings()
    truth = set()
    for i, text in docs:
        w = hashed(text).tolist()
        for k, item in items:
            own = hashed(item)
            answer = hashed(dc.last_sentence(item))
            for at in range(0, len(w), dc.BLOCK_WORDS):  # the windows that the search checks
                span = w[max(0, at - dc.BLOCK_WORDS) : at + (settings.passage_blocks + 1) * dc.BLOCK_WORDS]
                coverage = common_subsequence(places(own), len(own), span) / len(own)
                if coverage >= settings.covered or coverage >= settings.paraphrased and answer_share(places(answer), len(answer), span, settings.answer_spread) >= settings.answered:
                    truth.add((i, k))
    found = {(r.doc_id, r.item_id) for r in find_leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= truth and len(found) >= 0.95 * len(truth) > 100


def test_scripts_without_spaces_quotes_and_long_words(spark, make_docs):
    item = "东京是日本的首都，人口众多。它位于关东平原的南端，面向东京湾。"
    thue, other = "a", "b"
    for _ in range(10):
        thue, other = thue + other, other + thue
    docs = make_docs([(1, "前文很长。" * 9 + item + "后文也很长，" * 9), (2, "完全不同的一段文字，没有泄露任何内容，只是普通的句子。" * 3), (3, "“Quoted—words” " + thue), (4, "plain " + other)])
    benchmark = spark.createDataFrame([(1, item), (2, "quoted words " + thue)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()) == [(1, 1), (3, 2)]
    assert hashed(thue) != hashed(other) and len(hashed("a “b”—c 東京 d")) == 6


def test_columns_of_any_name_stay(spark, make_docs):
    docs = make_docs([(1, "a b c d e f g h"), (2, "other words here")]).selectExpr("*", "7 AS leak_key", "text AS words")
    kept = decontaminate(docs, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.leak_key, r.words) for r in kept] == [(2, 7, "other words here")]


def test_words_that_share_terms_lose_no_leak(spark, make_docs):
    """Some 10 words to a term, as with a million item words: cosines blur a little, so a few more pairs get to the checks, and no leak is lost."""
    docs, items, truth = setting()
    rng = random.Random(2)
    others = [(1000 + i, " ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"w{rng.randrange(20_000)}" for _ in range(40))) for i in range(1500)]
    benchmark = spark.createDataFrame(items + others, "item_id long, text string")
    vocabulary = dc.Vocabulary(np.unique(np.concatenate([hashed(t) for _, t in items + others])), 2048)
    assert vocabulary.size <= 2048 and len(vocabulary.words) > 16_000
    found = {(r.doc_id, r.item_id) for r in find_leaks(make_docs(docs), benchmark, Settings(term_slots=2048)).collect()}
    assert truth <= found and len(found - truth) <= 0.1 * len(truth)
    whole = np.arange(200_000, dtype=np.uint64) * np.uint64(7919)
    many = dc.Vocabulary(whole, 1 << 17)
    at, term = many.terms(whole[::5])
    assert len(at) == len(whole[::5]) and term.max() < many.size < 1 << 17 and (term == many.term[::5]).all()
