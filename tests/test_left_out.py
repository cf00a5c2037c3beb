"""Text that gives no section, and messages that aren't valid, with their reasons."""

from coursebank.operators import relational as rel
from coursebank.operators import structure as st


def test_left_out(spark):
    long = "nội dung của mục này khá dài. " * 10
    docs = spark.createDataFrame([
        (1, "chỉ một câu ngắn"), (2, f"lời mở đầu\n1.1 Một mục\n{long}\n1.2 Mục hai\nngắn"), (3, "x" * 2000 + "y" * 200),
        (4, None), (5, long * 2)], "doc_id long, text string")
    got = sorted((r.doc_id, r.reason, r.content) for r in st.left_out(docs).collect())
    assert got == [(1, "short", "chỉ một câu ngắn"), (2, "before_first_header", "lời mở đầu"), (2, "short", "ngắn"),
                   (3, "short", "y" * 200)]
    assert {r.doc_id for r in st.split_sections(docs).collect()} == {2, 3, 5}


def test_checked_feedback(spark):
    rows = [(1, " a@b.c ", " hi "), (2, None, "hi"), (3, "a@b.c", " "), (4, "a@b.c", "x" * 5001), (5, "a" * 256, "hi")]
    df = spark.createDataFrame(rows, "id int, email string, message string")
    got = {r.id: r.reason for r in rel.checked_feedback(df).collect()}
    assert got == {1: None, 2: "no_email", 3: "no_message", 4: "long_message", 5: "long_email"}
    assert [tuple(r) for r in rel.valid_feedback(df).collect()] == [(1, "a@b.c", "hi")]
