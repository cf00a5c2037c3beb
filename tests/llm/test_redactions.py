"""Redactions that overlap."""

from coursebank.llm import token_counts


def test_overlapping_matches_are_replaced_whole(spark):
    texts = ["john1987654@x.com", "key 0a1b2c3d4e5f1234567a8b9c0d1e2f3a end", "a@x.com b@y.com", "1234567 and 7654321"]
    rows = token_counts.redactions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        out = r.text
        for start, length, mark in token_counts.ordered_edits([e.asDict() for e in r.edits], len(r.text)):
            out = out[:start] + mark + out[start + length:]
        got[r.doc_id] = out
        assert all(a.start + a.length <= b.start for a, b in zip(r.edits, r.edits[1:]))
    assert got == {0: "<EMAIL>", 1: "key <SECRET> end", 2: "<EMAIL> <EMAIL>", 3: "<NUMBER> and <NUMBER>"}
