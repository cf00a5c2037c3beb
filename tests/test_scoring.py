import math
import random
from collections import Counter

from pyspark.sql import functions as F

from coursebank.functions import replies, scoring as sc
from coursebank.operators import grounding as gr
from coursebank.operators import scoring as ops


def test_overlaps(col):
    text = "mạng máy tính kết nối nhiều thiết bị khác nhau"
    assert col(sc.word_overlap, [(text, text), ("", text), ("xyz abc", text)]) == [1.0, 0.0, 0.0]
    assert col(sc.ngram_groundedness, [(text, text), (text, "khác"), ("mạng", text)]) == [1.0, 0.0222, 0.2]
    assert col(sc.concept_overlap, [("alpha beta", "alpha alpha gamma"), ("", "a"), ("abcd", "abcd"), ("xyz", "ab")]) == [0.5, 0.0, 1.0, 0.5]
    # H₂O and H2O are the same token once symbols are normalised.
    assert col(sc.ngram_groundedness, [("H₂O nước", "H2O nước")]) == [0.5]


def test_tautology(col):
    score = lambda a: F.round(sc.tautology(replies.answer_points(a)), 4)
    good = "- Khái niệm: hệ thống thông tin quản lý gồm phần cứng phần mềm"
    assert col(score, ["- Khái niệm: khái niệm", good, good + "\n- A: a", "không có ý"]) == [0.1, 1.0, 0.54, 1.0]


def test_point_overlap(col):
    same = "- Vai trò: quản lý tài nguyên hệ điều hành máy chủ\n- Vai trò: quản lý tài nguyên hệ điều hành máy chủ"
    apart = "- Một: alpha bravo charlie\n- Hai: delta foxtrot golf"
    over = lambda a: sc.max_point_overlap(replies.answer_points(a))
    got = col(over, [same, apart, "- one: x"])
    assert got[0] >= 0.62 and got[1] == 0.0 and got[2] == 0.0
    div = lambda o: sc.diversity(o, F.lit(2))
    assert col(div, [0.8, 0.6, 0.45, 0.3, 0.1], ["double"]) == [0.2, 0.5, 0.73, 0.8, 0.965]


def test_question_rules(col):
    rule = lambda q, n: sc.question_rule(F.lower(q), n)
    rows = [("Liệt kê các thành phần", 1), ("So sánh A và B", 1), ("Tại sao vậy", 1), ("Mô tả A", 1), ("Giải thích A", 2),
            ("Phân tích A", 2), ("Giả sử có A, áp dụng B", 3), ("Hãy mô tả A", 3), ("Câu hỏi tự luận", 3), ("Bất kỳ", 5)]
    got = col(rule, rows, ["string", "int"])
    assert [r.reason for r in got] == ["ok", "off_level", "asks_why", "verb_missing", "ok", "off_level_start", "ok",
                                       "describes_only", "meta", "ok"]
    assert [r.score for r in got] == [0.95, 0.12, 0.15, 0.22, 0.95, 0.15, 1.0, 0.20, 0.12, 1.0]


def test_step_rule(col):
    rule = lambda a: sc.step_answer_rule(F.lower(a), replies.answer_points(a))
    rows = ["", "- Thang đo Bloom: x", "- Phân tích định tính: x", "- Bước 1: phân tích\n- Bước 2 phân tích định tính: x\n- Bước 3 chỉ số KPI: y",
            "- Bước 1 chuẩn bị: x\n- Bước 2 thực hiện: y"]
    assert [r.reason for r in col(rule, rows)] == ["no_points", "meta", "template_title", "template_steps", "ok"]


def test_ceilings(col):
    long = " chữ" * 300
    cases = {"ngắn": 1, "Quy trình này giúp người học hiểu rõ vì sao cần thực hành mỗi ngày.": 2, "đề xuất giải pháp" + long: 6,
             "hạn chế" + long: 5, "hạn chế" + " chữ" * 80: 4, "so sánh" + long: 4, "các bước" + long: 3, "mô tả" + long: 2, "x" + long: 5}
    assert col(sc.section_ceiling, list(cases)) == list(cases.values())
    eff = lambda c, n, k: sc.effective_ceiling(c, n, k)
    assert col(eff, [(None, 3, 10), (3, 4, 200), (3, 2, 200), (3, 5, 900), (5, 6, 900)], ["int"] * 3) == [6, 4, 3, 5, 6]


def test_outcomes(col):
    gap = lambda q, a, o, n: sc.aspect_gap(q, a, o, F.lit(""), F.lit(""), n)
    verdict = lambda q, a, o, n: sc.aspect_verdict(gap(q, a, o, n), n)
    rows = [("q", "a", "không có", 3), ("So sánh", "lợi ích", "so sánh lợi ích", 3), ("q", "lợi ích", "so sánh lợi ích", 3),
            ("q", "a", "lợi ích", 1), ("q", "giúp", "lợi ích", 1), ("q", "a", "lợi ích, hạn chế", 4), ("lợi ích", "x", "lợi ích", 5)]
    assert col(verdict, rows, ["string"] * 3 + ["int"]) == [
        "ok", "ok", "skill_missing", "topic_missing", "ok", "topic_missing", "answer_topic_missing"]


def test_gate(spark):
    rich = "so sánh và phân tích " * 60
    rows = [(rich, "1.1 A", 4, 4, None, None), ("ngắn", "1.1 A", 1, 1, None, None), (rich, "1.1 A", 4, 2, None, None),
            (rich, "1.1 A", 2, 2, "thanh toán", None), (rich, "1.1 A", 2, 2, "so sánh thẻ", False)]
    df = spark.createDataFrame(
        [(i, *r, 0, 0) for i, r in enumerate(rows)],
        "i int, content string, title string, level int, ceiling int, clo string, clo_verdict boolean, chapter_chars int, chapter_words int")
    got = {r.i: r for r in ops.feasibility(df).collect()}
    assert [got[i].decision for i in range(5)] == ["pass", "fail", "fail", "fail", "pass"]
    assert got[1].reasons == ["content_too_short(4<40)"]
    assert got[2].reasons[-1] == "semantic_ceiling(2)<target(4)"
    assert got[3].reasons[0] == "fail_learning_outcome_low_overlap(0.00)"


def test_evaluation_bounds(spark):
    source = "Hệ điều hành quản lý tài nguyên phần cứng và cung cấp dịch vụ cho chương trình ứng dụng. " * 6
    answer = "\n".join(f"- Ý {w}: Hệ điều hành quản lý tài nguyên phần cứng và cung cấp dịch vụ {w}" for w in ("ứng", "chương"))
    rows = [(i, i, "Giải thích hệ điều hành", answer, source) for i in range(1, 7)]
    got = ops.evaluate_qa(spark.createDataFrame(rows, "id int, level int, question string, answer string, source string")).collect()
    assert all(0 <= r.quality <= 1 and 0 <= r.diversity <= 1 and r.groundedness > 0.5 for r in got)
    by = {r.level: r for r in got}
    assert by[1].fail_reason == "question_off_level" and by[4].decision == "pass"


def bleu(hyp, ref, n):
    """Plain definition: clipped precisions, 0.1 for zero counts, brevity penalty."""
    if not hyp or len(ref) < n:
        return 0.0
    logs = []
    for k in range(1, n + 1):
        h = Counter(tuple(hyp[i:i + k]) for i in range(len(hyp) - k + 1))
        r = Counter(tuple(ref[i:i + k]) for i in range(len(ref) - k + 1))
        m, t = sum((h & r).values()), max(1, sum(h.values()))
        if k == 1 and m == 0:
            return 0.0
        logs.append(math.log((m or 0.1) / t))
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return round(bp * math.exp(sum(logs) / n), 4)


def test_bleu(spark):
    pairs = [("a b c d e", "a b c d e"), ("a a a a", "a b a c"), ("x y", "a b c"), ("a", "a b c d"), ("a b c d e f g", "c d e f"), ("", "a")]
    rows = [(i, h.split(), r.split()) for i, (h, r) in enumerate(pairs)]
    got = gr.bleu_scores(spark.createDataFrame(rows, "i int, h array<string>, r array<string>"), ["i"], "h", "r")
    found = {r.i: (r.bleu1, r.bleu2, r.bleu4) for r in got.collect()}
    for i, h, r in rows:
        assert found[i] == tuple(bleu(h, r, n) for n in (1, 2, 4))


def test_attribution_with_copies(spark):
    passage = " ".join(f"từ{i}" for i in range(12))
    docs = [(i, passage + f" khác{i % 2}") for i in range(40)] + [(99, passage), (100, "hoàn toàn khác biệt với mọi đoạn văn")]
    got = gr.corpus_attribution(spark.createDataFrame([(1, passage)], "item_id bigint, text string"),
                                spark.createDataFrame(docs, "doc_id bigint, text string")).first()
    assert (got.best_doc, got.shared, got.n_grams, got.share, got.n_sources) == (0, 9, 9, 1.0, 41)


def test_attribution_equals_brute_force(spark, monkeypatch):
    """A gram of all documents, copies, passages without grams or source; lists cut into many small blocks."""
    monkeypatch.setattr(gr, "BLOCK_DOCS", 5)
    monkeypatch.setattr(gr, "LIST_BLOCKS", 2)
    rng = random.Random(3)
    common = "chung đoạn mở đầu riêng biệt"
    words = [f"từ{chr(97 + i)}" for i in range(12)]
    docs = [(i, common + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, docs[3][1]) for i in range(30)] + [(200, None), (201, "")]
    passages = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(15)]
    passages += [(50, common), (51, common + " " + docs[7][1]), (52, None), (53, ""), (54, "quá ngắn"), (55, "không nơi nào có những lời thế"), (56, common)]

    def grams(texts, key):
        df = spark.createDataFrame(texts, f"{key} bigint, text string")
        out = {}
        for r in gr.gram_rows(df, key, "text", 4).collect():
            out.setdefault(r[0], set()).add(r.gram)
        return df, out

    (p, pg), (d, dg) = grams(passages, "item_id"), grams(docs, "doc_id")
    want = {}
    for i, _ in passages:
        hits = sorted((-len(pg.get(i, set()) & g), k) for k, g in dg.items() if pg.get(i, set()) & g)
        top = hits[0] if hits else (0, None)
        n = len(pg.get(i, ()))
        want[i] = (top[1], -top[0], n, round(-top[0] / n, 4) if n else 0.0, len(hits))
    got = {r.item_id: tuple(r)[1:] for r in gr.corpus_attribution(p, d).collect()}
    assert got == want
    assert want[50][4] > 80 and want[55][4] == 0 and want[54][2] == 0
    few = gr.corpus_attribution(p, d, min_shared=3).collect()
    assert all(r.shared == 0 or r.shared >= 3 for r in few) and len(few) == len(passages)
    assert gr.corpus_attribution(p, d.where("false")).agg({"n_sources": "sum"}).first()[0] == 0
    assert gr.corpus_attribution(p.where("false"), d).count() == 0


def test_bleu_of_long_and_empty_texts(spark):
    rng = random.Random(1)
    long = [rng.choice("abcdefgh") for _ in range(6000)]
    rows = [(0, long, long[:5000]), (1, [], []), (2, None, ["a"]), (3, ["a"], None), (4, long[:900], [])]
    got = gr.bleu_scores(spark.createDataFrame(rows, "i int, h array<string>, r array<string>"), ["i"], "h", "r").collect()
    found = {r.i: (r.bleu1, r.bleu2, r.bleu4) for r in got}
    assert found[0] == tuple(bleu(long, long[:5000], n) for n in (1, 2, 4))
    assert all(found[i] == (0.0, 0.0, 0.0) for i in range(1, 5))


def test_answers_without_chapters_stay(spark):
    answers = spark.createDataFrame([(1, 10, "Một câu trả lời."), (2, 20, "Một câu."), (1, 11, None)], "doc_id bigint, pair_id bigint, answer string")
    chapters = spark.createDataFrame([(1, 0, "A", "Một câu trả lời ở đây. Và nữa."), (1, 1, "B", None)],
                                     "doc_id bigint, chapter_pos int, chapter string, content string")
    own = answers.selectExpr("doc_id", "pair_id", "'A' AS source_chapter")
    rows = gr.attribute_chapter(gr.chapter_scores(answers, chapters), own).collect()
    got = {r.pair_id: (r.best_chapter, r.best_score > 0) for r in rows}
    assert got == {10: ("A", True), 20: ("A", False), 11: ("A", False)}
