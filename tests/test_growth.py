"""Jobs whose time, stack or shuffled bytes must not grow faster than their input."""

import random
from collections import namedtuple
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.operators import grounding as gr
from coursebank.operators import ledger as lg
from coursebank.operators import structure as st
from coursebank.operators import scoring as ops
from coursebank.operators import terms as tm
from coursebank.plans import planning_queries as pq
from coursebank.plans import scoring_fixtures as sf
from coursebank.plans import text_fixtures as tf

T0 = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentence_score_of_a_long_run_of_names(col):
    run = " ".join(["Ânh", "Bob"] * 20_000)
    score = lambda s: tm.sentence_score(s, F.lit(9), tx.lit_array(["zz"]))
    # One name, however long; over 150 words earn nothing for their number.
    assert col(score, [run, run + " x " + run, " ".join(["word"] * 25)]) == [6, 12, 3]


def test_key_phrases_are_counted_without_a_row_a_gram(spark):
    text = "alpha beta gamma " * 4 + "delta " * 6 + "Omega Sigma. " * 3
    rows = [(1, text), (2, "alpha beta"), (3, None), (4, ""), (5, "alpha beta gamma " * 2), (5, "alpha beta gamma")]
    df = tm.key_phrases(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    got = {r.doc_id: r.phrases for r in df.collect()}
    assert set(got) == {1, 5}
    assert got[1] == ["delta delta", "alpha beta", "beta gamma", "alpha beta gamma", "delta delta delta"]
    # Rows of one document are counted together, but no phrase crosses from one into the other.
    assert got[5] == ["alpha beta", "beta gamma", "alpha beta gamma"]
    # Grams are not rows of a shuffle.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_deletion_requests_of_a_busy_address(spark):
    n, gap = 30_000, timedelta(minutes=15)
    rows = [(2 * i, T0 + timedelta(seconds=20 * i), "a@x", "request", None) for i in range(n)]
    rows += [(2 * i + 1, T0 + timedelta(seconds=20 * i + 50), "a@x", "confirm", 2 * i) for i in range(0, n, 7)]
    rows += [(10**6, None, "a@x", "request", None), (10**6 + 1, None, "a@x", "request", None)]
    confirmed = {r[4]: r[1] for r in rows if r[3] == "confirm"}
    want, last = {10**6: True, 10**6 + 1: True}, None
    for i, ts, *_ in rows[:n]:
        refused = last is not None and last[0] >= ts - gap and (last[1] is None or last[1] > ts)
        want[i] = not refused
        last = last if refused else (ts, confirmed.get(i))
    df = lg.deletion_requests(spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, email string, kind string, request_id bigint"))
    assert {r.event_id: r.accepted for r in df.collect()} == want
    # No address's history is gathered into one row, which a fold would copy at every step.
    assert "collect_list" not in plan_of(df)


def test_classes_behind_ranges_hold_the_same_characters(spark):
    points = [chr(x) for x in range(0x10000) if not 0xD800 <= x <= 0xDFFF] + ["\U0001D6FC"]
    df = spark.createDataFrame([(x,) for x in points], "x string")
    got = {n: {r.x for r in df.where(F.col("x").rlike(p)).collect()} for n, p in
           (("any", tx.ANY_SPACE), ("odd", tx.ODD_ONE), ("math", tx._MATH_ONE))}
    assert got["any"] == set(tx.SPACE_CHARS)
    assert got["odd"] == set(tx.SPACE_CHARS) - {" ", "\n"}
    assert got["math"] == set(lx.MATH_WORDS)


def test_grams_of_a_stored_array_take_no_slices(spark):
    words = [f"w{i}" for i in range(12_000)]
    df = spark.createDataFrame([(1, words), (2, ["a", "b"]), (3, ["a"]), (4, []), (5, None)], "i int, ws array<string>")
    rows = df.select("i", *[sc.ngrams(F.col("ws"), n).alias(f"g{n}") for n in (1, 2, 4)])
    got = {r.i: r for r in rows.collect()}
    assert got[1].g1 == words and got[1].g4 == [" ".join(words[i:i + 4]) for i in range(11_997)]
    assert [got[i].g2 for i in (2, 3, 4)] == [["a b"], [], []]
    # A slice copies the array of every stored row for each gram: quadratic in its length.
    assert "slice(" not in plan_of(rows)


def test_content_of_a_section_is_cut_out_once(spark):
    text = "".join(f"Chương {i}: Tiêu đề {i}\n" + "chữ thường dài. " * 12 + "\n" for i in range(1, 4))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = df.select(st.header_sections(F.col("text")).alias("s"))
    assert [(s.chapter, s.word_count, s.char_count) for s in rows.first().s] == [(f"Chương {i}", 36, 191) for i in (1, 2, 3)]
    assert plan_of(rows).count("\\A[^\\n]*\\n?") == 1
    # So is a long line that is broken at its inner headings.
    assert plan_of(df.select(tx.split_long_lines(F.col("text")).alias("t"))).count(tx.BREAK_RULES[2][0]) == 1


def test_book_parts_are_cut_in_one_pass(spark):
    texts = [None, "", "a" * 600, "a" * 601, "\U0001D6FC" * 700 + "\n" + "b" * 600]
    df = spark.createDataFrame([(i * 7 + 4, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = df.select("doc_id", tf.book_text().alias("text"))
    got = {(r.doc_id - 4) // 7: r.text for r in rows.collect()}

    def want(i, text):
        if text is None:
            return ""
        parts = [text[k:k + 600] for k in range(0, max(len(text), 1), 600)]
        return "\n".join(f"{k + 1}.\n{p}\n{tf.PHRASES[(i * 7 + 4 + k) % 8]}" for k, p in enumerate(parts))

    assert got == {i: want(i, t) for i, t in enumerate(texts)}
    # A substring for each part counts its characters from the start of the text.
    assert "* 600" not in plan_of(rows)


def test_pairs_are_dealt_out_after_their_joins(spark):
    answers = spark.createDataFrame([(1, 1, "a b c d e"), (1, 2, "x"), (2, 3, "q")], "doc_id bigint, pair_id bigint, answer string")
    chapters = spark.createDataFrame([(1, 0, "C", "A b c d e f. Other words here now.")], "doc_id bigint, chapter_pos int, chapter string, content string")
    scores = gr.chapter_scores(answers, chapters, 7, orders=(4,))
    # A number that is asked for is kept; partitions of a join are merged by their few bytes into fewer tasks than cores.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = f"Exchange RoundRobinPartitioning({tasks}), REPARTITION_BY_NUM"
    assert plan_of(scores).count(dealt) == 1
    assert {r.pair_id: r.bleu4 > 0 for r in scores.collect()} == {1: True, 2: False}
    # Documents with pairs stand close together in few splits of the scan; pairs are made by a join.
    asked = spark.createDataFrame([(1,), (3,)], "doc_id bigint")
    picked = tf.books(spark, SF, asked)
    assert plan_of(picked).count(dealt) == 1 and plan_of(sf.qa_pairs(spark, SF)).count(dealt) == 1
    assert {r.doc_id for r in picked.collect()} == {1, 3}


def test_candidates_of_an_assignment_are_made_once(spark):
    plan = plan_of(pq.j14_assignment_joined(spark, SF))
    assert "text:string" not in plan and plan.count("/ranked-") == 2


class Counted:
    """A state variable and timers in memory that count their calls."""

    def __init__(self):
        self.kept, self.timers, self.calls = {}, set(), 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def exists(self): return self._call(() in self.kept)
    def get(self): return self._call(self.kept.get(()))
    def update(self, value): self._call(self.kept.update({(): value}))
    def clear(self): self._call(self.kept.clear())
    def getValue(self, key): return self._call(self.kept.get(key))
    def updateValue(self, key, value): self._call(self.kept.update({key: value}))
    def removeKey(self, key): self._call(self.kept.pop(key, None))
    def iterator(self): return self._call(iter(list(self.kept.items())))
    def registerTimer(self, ms): self._call(self.timers.add(ms))


class CountedHandle(Counted):
    def __init__(self):
        super().__init__()
        self.states = []

    def getMapState(self, *_):
        self.states.append(Counted())
        return self.states[-1]

    getValueState = getMapState


def test_deletion_state_is_called_per_slot_not_per_event():
    from types import SimpleNamespace as N

    from coursebank.streaming import stateful as sl

    rng, minute = random.Random(3), 60_000_000
    Event = namedtuple("Event", "email ts at kind event_id request_id")
    rows = []
    for i in range(0, 20_000, 2):
        at = rng.randrange(2 * 1440 * minute)
        rows.append(Event(None, None, at=at, kind=1, event_id=i, request_id=None))
        rows.append(Event(None, None, at=at + rng.randrange(600 * minute), kind=0, event_id=i + 1, request_id=i))
    rows += [Event(None, None, at=5, kind=0, event_id=9, request_id=None), Event(None, None, at=6, kind=1, event_id=None, request_id=None)]
    rng.shuffle(rows)
    desk, handle = sl.DeletionDesk(15 * minute, 2880 * minute), CountedHandle()
    desk.init(handle)
    half = 1440 * 60_000
    got, start = [], N(getCurrentWatermarkInMs=lambda: 0)
    for lo in range(0, len(rows), 5000):
        list(desk.handleInputRows(("a@x",), iter(rows[lo:lo + 5000]), start))
    for mark in (half, 10 * half):
        for ms in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(ms)
            got += desk.handleExpiredTimer(("a@x",), N(getCurrentWatermarkInMs=lambda: mark), N(getExpiryTimeInMs=lambda: ms))
        assert mark > half or 0 < len(got) < 10_000
    want, last, made, seen = {}, None, {}, set()
    order = sorted(rows, key=lambda r: (r.at, r.kind, r.event_id is not None, r.event_id or 0))
    for r in order:
        if r.kind == 0:
            if r.request_id in made and r.at <= made[r.request_id] + 2880 * minute:
                want[r.request_id] = (True, made.pop(r.request_id), r.at)
                last = None if last and last[1] == r.request_id else last
            continue
        ok = not (last and last[0] >= r.at - 15 * minute)
        want[r.event_id] = (ok, r.at, None)
        if ok:
            last = (r.at, r.event_id)
            made[r.event_id] = r.at
    found = {}
    for r in got:
        found[r.event_id] = max(found.get(r.event_id, ()), (r.accepted, r.created, r.confirmed or -1))
    assert found == {k: (a, b, c or -1) for k, (a, b, c) in want.items()}
    assert sum(c for _, _, c in want.values() if c) and handle.calls + sum(s.calls for s in handle.states) < 4000


def test_outcome_terms_are_searched_for_in_a_section(spark):
    texts = ["mô hình kinh doanh, rủi ro_x", "Mô Hình. RỦI RO", "b2b2 b2b an ninh\U0001D6FC", "", None, "termınology terms (term)"]
    rows = [(t, x, o) for t in ("Mô hình an ninh", None) for x in texts for o in ("Mô hình rủi ro", "an ninh b2b term", "  ", "", None)]
    df = spark.createDataFrame(rows, "title string, content string, clo string")
    both = F.struct(sc.section_features(F.col("title"), F.col("content")).alias("s"), sc.outcome_features(F.col("clo")).alias("o"))
    want = F.when(F.col("clo").isNull() | (F.col("clo") == ""), F.lit(0.0)).otherwise(tx.bind(both, lambda x: sc.match_score(x["s"], x["o"])))
    got = df.select(sc.clo_score(F.col("title"), F.col("content"), F.col("clo")).alias("got"), want.alias("want"))
    assert got.count() == 60 and got.where("NOT got <=> want").count() == 0 and got.where("got > 0").count() > 5
    # Only the outcome is split into words, not the text and title of the section.
    assert plan_of(got.select("got")).count("regexp_extract_all") == 1


def test_texts_without_odd_spaces_and_numbers_stay(col):
    odd = [x for x in tx.SPACE_CHARS if x not in " \n"] + ["​", "‍", "﻿", "²", "₈", "⁺"]
    spaced = [f"so sánh{x}mô hình" for x in odd] + ["a  b", "a​ b", "² 　 x", "a\tb", "1.2 Một. 1.3 Hai", "plain, 1. 2", "so sánh\nmô", None]
    rules = lambda t: F.regexp_replace(tx.replace_each(F.regexp_replace(t, r"[\x{200B}-\x{200D}\x{FEFF}]", ""), {
        **{k: f"<sub>{v}</sub>" for k, v in lx.SUBSCRIPTS.items()}, **{k: f"<sup>{v}</sup>" for k, v in lx.SUPERSCRIPTS.items()}}), tx.SPACES, " ")
    assert col(tx.normalise_text, spaced) == col(rules, spaced)
    assert col(tx.break_inline_headings, ["Hết. 1.2 Một", "Hết. 2 Một", None]) == ["Hết.\n1.2 Một", "Hết. 2 Một", None]


def test_replies_are_read_once_for_both_gates(spark):
    text = "1.1 Khái niệm mô hình\n" + "Mô hình kinh doanh bao gồm các hoạt động và rủi ro thanh toán. " * 5
    books = st.sectioned(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    raw = "**QUESTION:** Nêu khái niệm mô hình?\nANSWER:\n- Mô hình: hoạt động kinh doanh và thanh toán\n- Rủi ro: rủi ro thanh toán của hoạt động"
    rows = [(1, 0, 1, 1, raw, 2, ""), (1, 0, 1, 2, "nothing", 2, ""), (1, 9, 4, 1, raw, 2, "")]
    replies = spark.createDataFrame(rows, "doc_id bigint, section_pos int, level int, attempt int, raw string, required_points int, clo string")
    judged = ops.judged_replies(replies, books)
    assert {(r.section_pos, r.attempt): r.why for r in judged.collect()}[0, 2] == "unreadable" and judged.count() == 3
    # The replies are read by neither the sources that are wanted nor the result.
    assert "QUESTION:" not in judged._jdf.queryExecution().optimizedPlan().toString()
