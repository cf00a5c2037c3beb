"""Chapter numbers, structured drafts, outcome coverage, sinks that may be repeated, and erasure over all tables."""

import re

import pytest

from coursebank import lexicons as lx
from coursebank.operators import outcomes as oc
from coursebank.operators import relational as rel
from coursebank.operators import structure as st
from coursebank.operators import terms as tm
from coursebank.plans import stream_queries as stq
from coursebank.session import shared_folder
from coursebank.sources import sinks
from coursebank.sources.tables import COURSE_SCHEMAS, load_course_table
from pyspark.sql import functions as F


def test_chapter_numbers(spark):
    texts = {
        1: "Chương 3\nchương  12 và CHƯƠNG 3", 2: "Phần IV, phần XX rồi Phần XXI và Phần IIII", 3: "phần iv", 4: None, 5: "",
        6: "Chapter 007 chapter\n2", 7: "Chương 99999999999999999999999 Chương một", 8: "Phần Iv"}
    df = spark.createDataFrame([*texts.items(), (1, "Chương 1")], "doc_id bigint, text string")
    got = [(r.doc_id, r.numbers, r.n_chapters) for r in st.chapter_numbers(df).collect()]
    assert sorted(got) == sorted([
        (1, [3, 12], 2), (1, [1], 1), (2, [4, 20], 2), (3, [], 1), (4, [], 1), (5, [], 1), (6, [2, 7], 2), (7, [], 1), (8, [], 1)])
    none = st.chapter_numbers(df.where("doc_id = 5")).first()
    assert none.chapters == ["Chương 1"]


def draft(sentences, n, titles, scores, picked=3):
    """The draft step by step; ``scores`` is None where no keywords are given."""
    meta = [re.compile(p.replace(r"\p{L}\p{N}", r"\w"), re.I) for p in lx.DRAFT_METADATA_STARTS]
    kept = [s for s in sentences if not any(m.match(s.strip()) for m in meta) and len(s.strip()) > 50 and len(s.split()) >= 25]
    if scores is not None and len(kept) > n * 2:
        at = sorted(range(len(kept)), key=lambda i: (-scores[kept[i]][i], i))
        kept = [kept[i] for i in at[:n * picked]]
    run, out = max(2, len(kept) // n) if n else 0, ""
    for i in range(n):
        title = titles[i] if i < len(titles) else f"Chi tiết bổ sung {i - len(titles) + 1}"
        part = list({s.lower().strip(): s for s in reversed(kept[i * run:(i + 1) * run])}.values())[::-1]
        if part:
            text = part[0]
            for j, s in enumerate(part[1:], 1):
                own = any(s.strip().startswith(w) for w in lx.DRAFT_LINKED_STARTS)
                text += f" {s.strip()}" if own else f" {lx.DRAFT_CONNECTORS[j % 7]} {s.strip()}"
            out += f"- {title}{text.strip()}"
    return out


def test_structured_draft(spark):
    long = lambda word, n=26: " ".join([word] * n)
    cases = [
        ([long("một"), long("hai"), long("ba"), "Ngoài ra " + long("bốn"), "Bài 3 " + long("x"), "ngắn"], 2, False),
        ([long("một"), long("MỘT"), long("một")], 1, False), ([], 3, False), ([long("a")], 7, False), ([long("a")], 0, False),
        ([long(f"từ{i}", 25 + i % 9) for i in range(14)] + [long("khóa"), long("khóa", 40)], 2, True),
        ([long("a"), None, long("b")], 2, False)]
    titles, schema = ["T1", "T2"], "i int, ss array<string>, n int, keyed boolean"
    df = spark.createDataFrame([(i, ss, n, keyed) for i, (ss, n, keyed) in enumerate(cases)], schema)
    words = F.when(F.col("keyed"), F.array(F.lit("khóa"))).otherwise(F.array().cast("array<string>"))
    got = {r.i: r.a for r in df.select("i", tm.structured_answer(
        F.col("ss"), F.col("n"), F.array(*map(F.lit, titles)), words).alias("a")).collect()}
    for i, (ss, n, keyed) in enumerate(cases):
        ss = [s for s in ss if s is not None]
        scores = None
        if keyed:
            rows = spark.createDataFrame([(s, p) for s in ss for p in range(len(ss))], "s string, p int")
            found = rows.select("s", "p", tm.sentence_score(F.col("s"), F.col("p"), F.array(F.lit("khóa"))).alias("v")).collect()
            scores = {}
            for r in found:
                scores.setdefault(r.s, {})[r.p] = r.v
        assert got[i] == draft(ss, n, titles, scores), i


def test_outcome_coverage(spark):
    sections = spark.createDataFrame(
        [(1, 0, "Khái niệm mô hình", "Định nghĩa mô hình và lợi ích."), (1, 1, "Hạn chế của mô hình", "Nhược điểm của mô hình này."),
         (1, 2, None, None), (2, 0, "Khác", "không liên quan")], "doc_id bigint, pos int, title string, content string")
    outcomes = spark.createDataFrame(
        [(1, 7, "Trình bày khái niệm mô hình, lợi ích, hạn chế và vai trò"), (1, 8, "  "), (1, 9, None), (2, 7, "Phân tích mô hình"),
         (3, 1, "không có tài liệu")], "doc_id bigint, outcome_id int, clo string")
    scores = oc.outcome_scores(sections, outcomes)
    rows = {(r.doc_id, r.outcome_id): r for r in oc.coverage(scores).collect()}
    assert set(rows) == {(1, 7), (1, 8), (1, 9), (2, 7)}
    full = rows[1, 7]
    assert (full.n_sections, full.best_pos, full.missing) == (2, 0, ["vai_tro"])
    assert set(full.covered) | set(full.missing) == set(full.asked) and not set(full.covered) & set(full.missing)
    assert full.ratio == round(len(full.covered) / len(full.asked), 4)
    for blank in (rows[1, 8], rows[1, 9]):
        assert (blank.n_sections, blank.best_pos, blank.asked, blank.ratio) == (0, None, [], 1.0)
    other = rows[2, 7]
    assert (other.n_sections, other.covered, other.ratio, other.skills_missing) == (0, [], 0.0, 1)
    ranked = [(r.pos, r.rank) for r in oc.ranked_matches(scores).where("doc_id = 1 AND outcome_id = 7").orderBy("rank").collect()]
    assert ranked == [(0, 1), (1, 2)]
    assert oc.coverage(oc.outcome_scores(sections.where("false"), outcomes)).count() == 0


def decided(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, pair_id bigint, level int, decision string, quality double, fail_reason string, "
                                       "groundedness double, verb double, question string, answer string, source string")


def test_repeated_writes_leave_the_same_rows(spark):
    rows = decided(spark, [(1, 10, 2, "pass", 0.61, None, 0.5, 1.0, "q", "a", "s" * 2000), (2, 11, 3, "fail", 0.1, "no_action", 0.2, 0.0, "q", "a", "s")])
    path = shared_folder(spark, "results")
    for batch in ("2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-01 00:00:00"):
        sinks.write_results(sinks.result_rows(rows, batch), path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("batch_id").distinct().count() == 2
    assert back.agg(F.max(F.length("content"))).first()[0] == sinks.RESULT_CONTENT_CHARS
    log = shared_folder(spark, "log")
    gate = spark.createDataFrame([(1, 0, 4, 5, "T", 120, 20, "fail", 0.3, ["a", "b"])],
                                 "doc_id bigint, pos int, level int, ceiling int, title string, content_len int, word_count int, decision string, quality double, reasons array<string>")
    reply = spark.createDataFrame([(1, 10, 2, "T", 4, True, None), (1, 12, 2, "T", 4, False, "unreadable")],
                                  "doc_id bigint, pair_id bigint, level int, title string, required_points int, accepted boolean, reject_reason string")
    for batch in ("b1", "b2", "b1"):
        for part in (sinks.gate_log(gate, batch), sinks.generation_log(reply, batch), sinks.evaluation_log(rows, batch)):
            sinks.write_log(part, log)
    found = sinks.read_log(spark, log)
    counts = {(r.batch_id, r.stage): r["count"] for r in found.groupBy("batch_id", "stage").count().collect()}
    assert counts == {(b, s): n for b in ("b1", "b2") for s, n in (("gate", 1), ("generation", 2), ("evaluation", 2))}
    one = {(r.stage, r.plan_item_id): r for r in found.where("batch_id = 'b2'").collect()}
    assert one["evaluation", "11"].reasons_json == '["no_action"]' and one["evaluation", "11"].target_bloom == "Bloom 3"
    assert sorted(r.quality_score for r in found.where("stage = 'generation' AND batch_id = 'b1'").collect()) == [0.0, 0.75]
    assert '"bloom_ceiling":5' in one["gate", None].metrics_json and one["gate", None].request_id == "b2/1"


@pytest.fixture
def small_store(spark):
    path = shared_folder(spark, "store")
    rows = {
        "users": ("id bigint, username string, is_admin boolean", [(1, "a", False), (2, "b", None), (3, "admin", True), (4, "d", False)]),
        "documents": ("id bigint, user_id bigint", [(10, 1), (11, 2), (12, None), (13, 3)]),
        "qa_results": ("id string, user_id bigint, document_id bigint", [("x", 1, 11), ("y", 2, 10), ("z", 4, 12), ("n", None, None), ("w", 4, 11)]),
        "transactions": ("id bigint, user_id bigint", [(1, 1), (2, 4), (3, None)]),
        "feedbacks": ("id bigint, user_id bigint", [(1, 2), (2, 3)]), "user_auth_providers": ("id bigint, user_id bigint", [(1, 1), (2, 4)]),
        "gate_logs": ("request_id string, user_id bigint, document_id bigint", [("g1", None, 10), ("g2", 2, None), ("g3", 4, 12)]),
        "generation_logs": ("request_id string, user_id bigint, document_id bigint", []),
        "evaluation_logs": ("request_id string, user_id bigint, document_id bigint", [("e1", 3, 13)]),
        "credit_packages": ("id bigint", [(1,)]), "subscription_packages": ("id bigint", [(1,)]), "system_settings": ("key string", [("k",)])}
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}")
    return path


def test_erasure_of_all_tables(spark, small_store):
    target = shared_folder(spark, "erased")
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (77,), (None,)], "user_id bigint")
    for _ in range(2):
        report = {r.table_name: (r.n_before, r.n_after) for r in rel.erase_store(spark, small_store, target, ids).collect()}
    assert set(report) == set(COURSE_SCHEMAS)
    left = {name: sorted(str(r[0]) for r in load_course_table(spark, f"{target}/{name}", name).select(
        "key" if name == "system_settings" else "request_id" if name.endswith("logs") else "id").collect()) for name in COURSE_SCHEMAS}
    assert left["users"] == ["3", "4"] and left["documents"] == ["12", "13"]
    assert left["qa_results"] == ["n", "z"] and left["transactions"] == ["2", "3"]
    assert left["feedbacks"] == ["2"] and left["user_auth_providers"] == ["2"]
    assert left["gate_logs"] == ["g3"] and left["evaluation_logs"] == ["e1"] and left["system_settings"] == ["k"]
    assert report["qa_results"] == (5, 2) and report["generation_logs"] == (0, 0)


def test_decision_log_writes_every_stage_twice(spark, tmp_path, monkeypatch):
    text = "1.1 Khái niệm mô hình\n" + "Phân tích mô hình kinh doanh và đánh giá rủi ro thanh toán. " * 12
    docs = [(i, text + f"Tài liệu số {i}.", "vi", "s", 700) for i in range(1, 5)]
    said = [(i, t, "user" if t % 2 == 0 else "assistant", f"Nội dung thứ {i}. Quy trình bao gồm các bước.") for i in range(1, 5) for t in range(4)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    writes, write = [], sinks.write_log

    def noted(rows, path):
        writes.append((rows.select("stage").first().stage, rows.count()))
        write(rows, path)

    monkeypatch.setattr(sinks, "write_log", noted)
    found = stq.a11_decision_log(spark, str(tmp_path)).groupBy("stage").count().collect()
    rows = {r.stage: r["count"] for r in found}
    assert rows["generation"] == rows["evaluation"] == 8 and rows["gate"] >= 24 and rows["gate"] % 6 == 0
    # The whole log of each stage is written a second time, and stays as after the first.
    assert sorted(writes) == sorted(2 * [*rows.items()])
