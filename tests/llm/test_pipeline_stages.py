"""Stages of the pipeline against brute force, on small tables."""

import itertools
import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)


def test_near_copies_by_five_words(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(40, 120))).split() for _ in range(12)]
    for words in texts[:]:
        for changes in range(1, 7):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"x{rng.randrange(10 ** 6)}"
            texts.append(copy)
    # Exactly 0.8: 20 of 25 five-word shingles are common.
    base = [f"v{i}" for i in range(24)]
    texts += [base, base + [f"z{i}" for i in range(5)]]

    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    between = 0
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
                between += 100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b])
    assert between  # pairs that only these values link
    assert len(sets[-1] & sets[-2]) * 5 == len(sets[-1] | sets[-2]) * 4
    got = corpus_pipeline.one_of_each_group(spark, _docs(spark, [(i, " ".join(w), "s") for i, w in enumerate(texts)]), "")
    assert sorted(r.doc_id for r in got.collect()) == [i for i, r in enumerate(root) if i == r]


def test_copies_are_no_boilerplate(spark):
    copy = "a clean text\nof two lines"
    rows = [(i, copy if i % 3 == 0 else f"menu\npage {i}", "s") for i in range(60)]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, _docs(spark, rows), "").collect()}
    # A third of the source is copies of one text; the menu stands on 40 of 41 different texts.
    assert got == {i: copy if i % 3 == 0 else f"page {i}" for i in range(60)}
    kept = corpus_pipeline.one_of_each_group(spark, _docs(spark, [(i, got[i], "s") for i in got]), "").collect()
    assert [r.doc_id for r in kept if r.text == copy] == [0]


def test_repeated_ids(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(3, text("a"), "s"), (7, text("a") + " more", "s"), *[(7, text(x), "s") for x in "bcdefgh"],
            (8, text("b"), "t"), (9, text("i"), "s"), (9, text("i"), "s"), (5, "", "s"), (5, "", "s"), (6, "", "s")]
    got = corpus_pipeline.one_of_each_group(spark, _docs(spark, rows), "").collect()
    want = [(3, text("a")), *[(7, text(x)) for x in "bcdefgh"], (9, text("i")), (5, ""), (6, "")]
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
