"""Rules read the whole text unless a query asks for the beginning that its SQL reads."""

from pyspark.sql import functions as F

from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.operators import grounding as gr
from coursebank.operators import scoring as ops
from coursebank.operators import structure as st
from coursebank.operators import terms as tm

FILL = "lorem ipsum dolor. " * 600  # 11,400 characters


def test_outcome_late_in_a_section(spark, col):
    rows = [("Tên", FILL + "mạng máy tính kết nối", "mạng máy tính kết nối")]
    assert col(lambda t, x, o: sc.clo_score(t, x, o), rows)[0] > 0 == col(lambda t, x, o: sc.clo_score(t, x, o, 8000), rows)[0]
    df = spark.createDataFrame(rows, "title string, content string, clo string")
    assert ops.gate_features(df).first().clo_fit > 0 == ops.gate_features(df, 8000).first().clo_fit


def test_aspects_late_in_a_section(col):
    gap = lambda n: (lambda x: sc.aspect_gap(
        F.lit(""), F.lit(""), F.lit("định nghĩa mô hình"), F.lit("x"), x, F.lit(2), n))
    assert col(gap(None), [FILL + "b2b"])[0].topics == ["mo_hinh"]
    assert col(gap(6000), [FILL + "b2b"])[0].topics == ["khai_niem"]


def test_stem_snippets_and_structure_late_in_a_text(spark, col):
    assert col(tx.is_stem, [FILL + "H2O"]) == [True] and col(lambda x: tx.is_stem(x, 2000, 3000), [FILL + "H2O"]) == [False]
    late = FILL + "alpha bravo charlie delta foxtrot golf hotel."
    assert "alpha" in col(tx.ranked_snippets, [late])[0][0]
    assert not any("alpha" in s for s in col(lambda x: tx.ranked_snippets(x, lead_chars=4500), [late])[0])
    docs = spark.createDataFrame([(1, FILL + "\n1.2 Tên")], "doc_id long, text string")
    assert st.detect_structure(docs).first().kind == "decimal" and st.detect_structure(docs, 3000).first().kind == "none"


def test_phrases_and_references_late_in_a_text(spark, col):
    docs = spark.createDataFrame([(1, "a1 " * 2000 + "quick brown foxes " * 9)], "doc_id long, text string")
    assert tm.key_phrases(docs, "doc_id", "text").count() == 1 and tm.key_phrases(docs, "doc_id", "text", lead_chars=5000).count() == 0
    ref = " ".join(f"Sentence number {i} here." for i in range(20))
    words = lambda n: col(lambda h, r: F.size(gr.reference_words(h, r, n)), [("sentence", ref)])[0]
    assert (words(None), words(7)) == (80, 28)
