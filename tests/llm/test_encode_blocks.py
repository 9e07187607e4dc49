"""Blocks of any size give the same ids, and both ways of splitting agree."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import encode


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127)))
def test_splitting_of_ascii(text):
    import regex

    assert encode._ascii.findall(text) == regex.findall(encode.PATTERN, text)


def test_blocks_of_any_size(spark, monkeypatch):
    rows = [(i % 7, t) for i, t in enumerate(["it's a root  of 12 parts", None, "", "ಮೂಲ root 🌿", " \n\t ", "root root root", "a" * 3000 + " b"] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((r.id, list(r.ids)) for r in encode.token_ids(df, "doc_id", "text").collect())
    own = encode._encoding(open(encode.RANKS, "rb").read())
    assert want == sorted((i, own.encode_ordinary(t or "")) for i, t in rows)
    monkeypatch.setattr(encode, "TEXTS", 2)
    monkeypatch.setattr(encode, "WORDS", 3)
    monkeypatch.setattr(encode, "HOT", 1)
    assert sorted((r.id, list(r.ids)) for r in encode.token_ids(df, "doc_id", "text").collect()) == want
    assert sorted((r.id, r.n_tokens) for r in encode.token_totals(df, "doc_id", "text").collect()) == sorted((i, len(v)) for i, v in want)
