"""Operators against brute force, on small tables with nulls, empty texts, ties and clashing columns."""

import gc
import itertools
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from coursebank.llm import byte_bpe, jaccard, lines, mixing, near_vectors, quality, repeats, token_counts, token_files
from coursebank.llm import toxicity
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "  \n\t", "One two", "ONE two", BASE, BASE, BASE + " more", BASE.replace("word3 ", "other "),
         "é ☃ it's 123!!\r\n" * 5, "a" * 300, "x y " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 9 else None, t, None if i % 3 == 0 else f"s{i % 2}", i, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, score string")


def test_jaccard(docs):
    def shingles(t):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\r", " ").split()]
        return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    sets = {i: shingles(t) for i, t in enumerate(TEXTS) if i != 9}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a] | sets[b])):
                root[a] = root[b] = min(root[a], root[b])
    assert {i: got[i] for i in sets} == {i: (len(sets[i]), root[i]) for i in sets}
    assert None in got


def test_token_files(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    got = sorted(token_files.token_files(docs, path).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    for r in got:
        n = len(tok.encode(TEXTS[9 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (start, n)
        start += n
    assert len(got) == len(TEXTS)
    assert token_files.token_files(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(1).integers(0, 2 ** bits, 40003, dtype=np.uint64).astype("<u4")
    shard = token_files.Shard(token_files.shard_bytes([1, None], [ids[:9], ids[9:]], bits))
    assert (shard.read(0, 40003) == ids).all() and (shard.read(16000, 33001) == ids[16000:33001]).all()


def test_mix(docs):
    rows = mixing.mix(docs, block=7).collect()
    assert len(rows) == len(TEXTS) and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - k) <= 1 for t, k in by.values())
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block=7).collect()))
    assert mixing.mix(docs.where("false")).count() == 0


def test_repeats(docs):
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    order = [*[i for i in range(len(TEXTS)) if i != 9], 9]
    seen = set()
    for i in order:
        raw = (TEXTS[i] or "").encode()
        cover, new = [False] * len(raw), set()
        for p in range(len(raw) - 49):
            new.add(raw[p:p + 50])
            if raw[p:p + 50] in seen:
                cover[p:p + 50] = [True] * 50
        seen |= new
        r = got[i if i != 9 else None]
        assert (r.n_bytes, r.n_removed) == (len(raw), sum(cover))
        assert bytes(r.kept) == bytes(b for b, c in zip(raw, cover) if not c)


def test_only_repeated_grams_go_on(spark):
    """Every text learns which of its own grams others have, so contexts of single grams are never dealt out."""
    rng = np.random.default_rng(3)
    own = [bytes(rng.integers(97, 123, 400, dtype=np.uint8)).decode() for _ in range(8)]
    common = "a passage that all but the last of these texts hold, in one place or another; it is long enough"
    rows = [(i, t + common if i < 7 else t) for i, t in enumerate(own)]
    found = repeats.repeated_grams(spark.createDataFrame(rows, "key long, text string"), 3, 50, 25).collect()
    raw = np.frombuffer(common.encode(), np.uint8)
    inside = set(repeats._low(repeats.gram_hashes(raw, 25)).tolist())
    assert sorted(r.key for r in found) == list(range(7))
    assert all(r.grams and set(r.grams) <= inside for r in found)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(i, f"this is you {'idiot' if i % 2 else 'friend'} number {i % 7}!") for i in range(400)],
                                 "doc_id long, text string")
    rows = toxicity.train(many, labels).score(many).collect()
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in rows)
    assert toxicity.train(docs, labels.where("false")).score(docs).where("score = 0").count() == len(TEXTS)
    assert toxicity.train(docs, labels.where("false")).accepted(docs).columns == docs.columns


def test_quality(docs):
    rows = quality.apply_policy(quality.ledger(docs))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[5].n_words == 60 and got[5].n_repeat_words == 0 and got[5].kept
    assert got[11].n_repeat_words == 800 and got[11].base_failed
    only = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(rows).collect()}
    assert only["repeated_words"][0] >= 1


def test_byte_bpe(docs):
    code = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS),
                             special_tokens={})
    for r in byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = TEXTS[9 if r.doc_id is None else r.doc_id] or ""
        assert list(r.ids) == code.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_edited_counts(docs):
    split, count = token_counts._counter(RANKS, public_tokenizers.PATTERN)
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(2).alias("length"), F.lit(" new").alias("text")))
    for r in token_counts.count_edited(docs.withColumn("edits", edits), RANKS, public_tokenizers.PATTERN).collect():
        text = TEXTS[9 if r.doc_id is None else r.doc_id] or ""
        want = text[:3] + " new" + text[5:] if len(text) >= 3 else text
        assert (r.n_before, r.n_after) == (sum(count(split(text))), sum(count(split(want))))


def test_site_lines(spark):
    rows = [(i, "h" if i < 12 else None, f"menu\npage {i}\n\n menu") for i in range(14)] + [(99, "h", None)]
    out = lines.drop_boilerplate(spark.createDataFrame(rows, "id int, host string, text string"), F.col("host"), F.col("text"))
    got = {r.id: (r.clean_text, r.n_dropped) for r in out.collect()}
    assert got[3] == ("page 3\n", 2) and got[13] == ("menu\npage 13\n\n menu", 0) and got[99] == (None, 0)


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    vecs = np.concatenate([base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:5]])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (None, rows[0][1])]
    got = {r.vec_id: r for r in near_vectors.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    assert [got[i].n_links for i in range(len(vecs))] == list(link.sum(1) - 1)
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102)) and not got[None].kept


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and set(rows.columns) == {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"}


def test_lines_with_clashing_names(spark):
    rows = [(i, "shared\nown " + str(i), "h", "x", 7, 8, None) for i in range(9)] + [(9, None, None, None, None, None, "t")]
    df = spark.createDataFrame(rows, "id int, text string, host string, site string, n_lines int, N_Dropped int, clean_text string")
    got = lines.drop_boilerplate(df, F.col("host"), F.col("text"))
    assert sorted(got.columns) == sorted(["id", "text", "host", "site", "clean_text", "n_lines", "n_dropped"])
    found = {r.id: (r.site, r.clean_text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert found == {i: ("h", f"own {i}", 2, 1) for i in range(9)} | {9: (None, None, 0, 0)}
    assert lines.drop_boilerplate(df.where("false"), F.col("host"), F.col("text")).count() == 0


def test_byte_bpe_keeps_recurring_words(monkeypatch):
    coder = byte_bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    coder.open()
    learned, learn = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda new: (learned.append(sorted(new)), learn(new)))
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 3000)
    texts = [f"again{' qx'.join(str(k) for k in range(n, n + 8))}" for n in (0, 900)]
    got = [coder.encode([t]) for t in texts]
    assert learned[0] and "again" in learned[0] and len(learned) == 2 and "again" not in learned[1]
    code = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t, (ids, raw) in zip(texts, got):
        assert np.frombuffer(ids[0], np.int32).tolist() == code.encode_ordinary(t) and raw[0] == t.encode()
    coder.close()


def test_byte_bpe_holds_little():
    """A slice's words and a task's coded words are held in flat arrays, not as objects for every occurrence."""
    coder = byte_bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    coder.open()
    text = " ".join(f"w{k % 500}" for k in range(200_000))
    coder.encode([text])
    tracemalloc.start()
    ids, raw = coder.encode([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert raw[0] == text.encode() and most < 45 * len(text)
    words = [f" zq{k}x" for k in range(4000)]
    tracemalloc.start()
    coder.learn(words)
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert all(w in coder.known for w in words) and kept < 140 * len(words)
    coder.close()
