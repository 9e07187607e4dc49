"""Verification under insertions, deletions and moves; exact candidates; repeats, tiny texts and hot keys."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import near_copies


def score(a, b):
    sa, sb = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
    return 1.0 if a == b else len(sa & sb) / len(sa | sb) if sa and sb else 0.0


@settings(max_examples=2000, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([4, 12, 500]), st.integers(3, 120), st.floats(0, 0.3))
def test_similarity_under_edits(seed, letters, size, share):
    dice = random.Random(seed)
    a = [f"w{dice.randrange(letters)}" for _ in range(size)]
    b = []
    for w in a:
        r = dice.random()
        if r < share / 3:
            b += [w, f"w{dice.randrange(letters)}"]
        elif r < 2 * share / 3:
            b.append(f"x{dice.randrange(letters)}")
        elif r > share:
            b.append(w)
    if dice.random() < 0.3 and len(b) > 4:
        k = dice.randrange(len(b))
        b = b[k:] + b[:k]
    got, true = near_copies.similarity(a, b, 0.6), score(a, b)
    assert (got > 0.6) == (true > 0.6) and (got <= true + 1e-12 or true <= 0.6)


def test_words_inserted_everywhere():
    a = [f"w{i}" for i in range(200)]
    for step in (3, 8, 9, 30):
        b = [x for i, w in enumerate(a) for x in ([w, f"n{i}"] if i % step == 0 else [w])]
        assert (near_copies.similarity(a, b, 0.6) > 0.6) == (score(a, b) > 0.6)


def pairs(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    return {tuple(r) for r in near_copies.similar_pairs(near_copies.sketched(df), **how).collect()}


def test_every_candidate_is_exact_enough(spark, monkeypatch):
    """Pairs just above the threshold: with agree=1 hardly any is lost, however crowded the buckets are; every number of agreeing sketches gives the same
    pairs with small buckets and with crowds."""
    dice = random.Random(5)
    texts = []
    for _ in range(120):
        a = [f"w{dice.randrange(4000)}" for _ in range(90)]
        b = [f"n{dice.randrange(4000)}" if dice.random() < 0.075 else w for w in a]
        texts += [" ".join(a), " ".join(b)]
    want = {(i, i + 1) for i in range(0, 240, 2) if score(texts[i].split(), texts[i + 1].split()) > 0.6}
    found = {n: pairs(spark, texts, agree=n) for n in (1, 2, 3)}
    assert found[3] <= found[2] <= found[1] <= want and len(found[1]) >= 0.97 * len(want) and len(want) > 40
    monkeypatch.setattr(near_copies, "CROWD", 1)
    assert {n: pairs(spark, texts, agree=n) for n in (1, 2, 3)} == found
    monkeypatch.setattr(near_copies, "HOT", 1)
    monkeypatch.setattr(near_copies, "SHARE", 1)
    assert pairs(spark, texts) == found[3]


def test_repeats_and_tiny_texts(spark):
    dice = random.Random(6)
    once = [f"w{dice.randrange(5000)}" for _ in range(60)]
    short = [f"s{i}" for i in range(30)]
    texts = [" ".join(once), " ".join(once * 3), " ".join(short), " ".join([*short, "more"]), " ".join(short[:5]), " ".join(short[:6]), "a b", "a b", "a", None, " - "]
    assert pairs(spark, texts) == {(0, 1), (2, 3), (4, 5), (6, 7)}


def test_words_of_few_and_many_marks():
    from lexmill.llm import near_copies

    for marks in ("—", "“”—…", "".join(map(chr, range(0x2010, 0x2060)))):
        text = "Ān " + "".join(f"oil{m}Root{m} १२ " for m in marks) + "x_y"
        assert near_copies.words_of(text) == [w.encode() for w in near_copies._word.findall(text.lower())]
