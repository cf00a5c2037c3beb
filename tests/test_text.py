from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import labels, replies, text as tx


def test_bloom_labels(col):
    cases = {
        None: lx.BLOOM_LABELS[0], "": lx.BLOOM_LABELS[0], "Bloom 3 (x)": lx.BLOOM_LABELS[2], "Bloom 9 (x)": "Bloom 9 (x)",
        "bloom (": "bloom (", "Nhớ lại": lx.BLOOM_LABELS[0], "Apply it": lx.BLOOM_LABELS[2], "Synthesis": lx.BLOOM_LABELS[5],
        "  ĐÁNH GIÁ ": lx.BLOOM_LABELS[4], "bloom 4": lx.BLOOM_LABELS[3], "bloom 8": lx.BLOOM_LABELS[0], "other": "other",
    }
    assert col(labels.normalise_bloom, list(cases)) == list(cases.values())
    assert col(labels.bloom_number, ["Bloom 2 (Hiểu)", "x"]) == [2, None]
    assert col(labels.bloom_code, ["Bloom 2 (Hiểu)", "x"]) == ["B2", "x"]
    assert col(labels.bloom_short, ["Bloom 2 (Hiểu)", "", "x"]) == ["Bloom 2 · Hiểu", "—", "x"]


def test_points(col):
    got = col(lambda a, b: labels.points(a, b), [("Bloom 1 (Nhớ)", None), ("Bloom 6", 0.0), ("Bloom 2", 0.6)], ["string", "double"])
    assert [(r.total_points, r.sub_points_count) for r in got] == [(1.0, 4), (3.5, 14), (0.6, 2)]
    assert got[2].points_breakdown == "Ý 1: 0.25đ | Ý 2: 0.25đ"


def test_display_name(col):
    rows = [("A", "u", "e@x", 1), ("", "u", "e@x", 1), (None, None, "e@x", 1), (None, "", None, 7)]
    assert col(labels.display_name, rows, ["string"] * 3 + ["int"]) == ["A", "u", "e", "User 7"]


def test_normalise(col):
    assert col(tx.normalise_text, ["a b​  c\t\td\n e", "H₂O x²"]) == ["a b c d\n e", "H<sub>2</sub>O x<sup>2</sup>"]
    assert col(tx.normalise_math, ["H₂SO₄ x² π≤α", "plain"]) == ["H2SO4 x2 pi<=alpha", "plain"]
    assert col(tx.stem_count, ["α∑² ×a"]) == [4]
    assert col(tx.strip_lines, ["  a \n b  \n"]) == ["a\nb"]


def test_language_tests(col):
    viet = "Hệ điều hành là phần mềm quản lý tài nguyên của máy tính điện tử"
    legacy = "HÖ ®iÒu hµnh lµ phÇn mÒm qu¶n lý tµi nguyªn cña m¸y tÝnh"
    assert col(tx.is_garbled, [viet, legacy, "plain english text of some length", "short", None]) == [False, True, False, True, True]
    assert col(tx.is_english, [viet, "plain english text of some length", "short", None]) == [False, True, False, False]


def test_mojibake(col):
    broken = "GiÃ¡o trÃ¬nh Ä‘iá»‡n"
    assert col(tx.fix_mojibake, [broken, "Giáo trình điện", "café", "x Ã© y", "éÃ©Ã", "plain", ""]) == [
        "Giáo trình điện", "Giáo trình điện", "café", "x é y", "ééÃ", "plain", ""]


def test_titles(col):
    cases = {"1. 4. 1 Khái niệm": "1.4.1", "5.1.2.1 A": "5.1.2.1", "x 2.3 y": "2.3", "PHẦN ii x": "Phần II",
             "Chương 3: x": "Chương 3", "Mục 5.1: x": "Mục 5.1", "16 Tên mục": "16", "Tên": None}
    assert col(tx.section_number, list(cases)) == list(cases.values())
    assert col(tx.repair_title, ["lư ợng hàng", "thôngbáo", "BộCông", "vàđảm bảo", "d ụng"]) == [
        "lượng hàng", "thông báo", "Bộ Công", "và đảm bảo", "dụng"]
    assert col(tx.is_chapter_title, ["Chương 1", "1.2 Chương", "Bài 3", "x", None]) == [True, False, True, False, False]
    assert col(tx.is_usable_title, ["1.2 x", "1. Giới", "Trang 3", "Lời nói", "MỤC 2", None]) == [True, True, True, False, True, False]
    assert col(tx.display_title, ["1.2 Khái niệm", "Chương 3: Mạng", "Bài 2. Cơ sở", "Chương 4"]) == ["Khái niệm", "Mạng", "Cơ sở", "Chương 4"]
    assert col(lambda t: tx.cut_title(t, 12), ["the cat sat over there", "short", "a" * 30]) == ["the cat sat", "short", "a" * 12]
    assert col(tx.roman_to_int, ["xiv", "XXX", "7"]) == ["14", "30", "7"]


def test_labels_in_english(col):
    assert col(lambda t: tx.localise_section(t, "en"), ["Chương 2 - Mục 2.1: x", "Chương 1 - Mục Chương 1: y"]) == [
        "Chapter 2 - Section 2.1: x", "Chapter 1: y"]
    rows = [("Chương 1", "1.2", "T", 4), ("Chương 1", None, "T", 4), ("Chương 1", None, "T", None)]
    types = ["string", "string", "string", "int"]
    assert col(lambda a, b, t, p: tx.section_label(a, b, t, p), rows, types) == ["Chương 1 - Mục 1.2: T", "Trang 4: T", "Chương 1: T"]
    assert col(lambda a, b, t, p: tx.section_label(a, b, t, p, "en"), [("Chương 1", "Chương 1", "T", 1)], types) == ["Chapter 1: T"]


def test_line_breaks(col):
    assert col(tx.break_inline_headings, ["Kết thúc. 1.2 Tiêu đề", "bản 2.0 x"]) == ["Kết thúc.\n1.2 Tiêu đề", "bản 2.0 x"]
    long_line = "a" * 410 + " Chương 2 b"
    assert col(tx.split_long_lines, [long_line, "x Chương 2 b"]) == ["a" * 410 + "\nChương 2 b", "x Chương 2 b"]


def test_replies(col):
    raw = "**BLOOM:** Bloom 2\n**QUESTION:** Nêu gì?\nANSWER:\n- A: b\n- C: d"
    r = col(replies.read_reply, [raw, "QUESTION: q ANSWER", "BLOOM: 1\nQUESTION: q\nANSWER: - x: y"])
    assert (r[0].bloom, r[0].question, r[0].answer) == ("Bloom 2", "Nêu gì?", "- A: b\n- C: d")
    assert r[1].answer is None
    assert r[2].answer == "- x: y"
    v = col(replies.read_verdict, ["Decision: PASS\nReason: r\n feedback: f", "nothing"])
    assert (v[0].decision, v[0].reason, v[0].feedback) == ("pass", "r", "f") and v[1].decision == "fail"
    assert col(replies.read_level, ["**3** | x", "level 5 of 6", "9", None]) == [3, 5, None, None]
    e = col(lambda t: replies.enforce_points(t, F.lit(2)), ["intro\n- a\nmore\n- b\n- c", "- a", "plain"])
    assert [(x.answer, x.n_blocks, x.short) for x in e] == [("intro\n- a\nmore", 4, False), ("- a", 1, True), ("plain", 1, True)]
    assert col(replies.clean_answer, ["**a** *b* __c__\n[Tiêu đề]\nNội dung: x\nTheo tài liệu, y. Như vậy, z"]) == [
        "a b c\nTiêu đề\nx\ny. z"]
    points = col(replies.answer_points, ["- A: b: c\nx\n-  d\n- : e"])[0]
    assert [(p.title, p.content) for p in points] == [("A", "b: c"), ("", "d"), ("", "e")]


def test_notices(col):
    notes = col(replies.read_notification, ['{"content":"DH 12","transferAmount":5}', '{"description":"d","amount":"7"}',
                                            '{"content":"","transferAmount":0,"amount":"x"}', "{}"])
    assert [(n.content, n.amount) for n in notes] == [("DH 12", 5.0), ("d", 7.0), ("", 0.0), ("", 0.0)]
    assert col(replies.order_code, ["chuyen tien dh  12 x", "none", None]) == ["12", None, None]


def test_hmac(col):
    import hashlib
    import hmac

    want = hmac.new(b"key", "a=1&b=x".encode(), hashlib.sha512).hexdigest()
    assert col(lambda t: replies.hmac_sha512(t, "key"), ["a=1&b=x"]) == [want]
    long = "k" * 200
    want = hmac.new(long.encode(), b"m", hashlib.sha512).hexdigest()
    assert col(lambda t: replies.hmac_sha512(t, long), ["m"]) == [want]
    signed = lambda t: replies.signed_text(F.create_map(F.lit("b"), t, F.lit("a"), F.lit("~*")))
    assert col(signed, ["x y&é"]) == ["a=~%2A&b=x+y%26%C3%A9"]


def test_all_white_space_counts(col):
    """Separators of files and records, and the next-line sign, are white space, in ASCII texts and others."""
    odd = "\x1c\x1d\x1e\x1f"
    assert col(tx.strip, [(f"{odd} a\x85b \x85{odd}",)]) == ["a\x85b"]
    assert col(lambda x: F.size(tx.words(x)), [("a\x1cb\x1fc\x85d",)]) == [4]
    assert col(tx.normalise_text, [("a\x1c \x1db",), ("ạ\x85\x1fb",), ("a  b",), ("a\nb",)]) == ["a b", "ạ b", "a b", "a\nb"]
