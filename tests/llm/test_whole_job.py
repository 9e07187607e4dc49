"""Small cases in which an operator once did less than its whole job."""

import random
from collections import Counter

from lexmill.llm import private, scan_repair, term_counts, together


def test_runs_of_any_length(spark):
    """Every run of every length, in repeats within a record too, against counting them one by one."""
    dice = random.Random(3)
    rows = [(i, [dice.choice("abc") for _ in range(dice.randrange(0, 14))], [dice.choice("xy\t") + dice.choice("uv") for _ in range(dice.randrange(0, 6))]) for i in range(60)]
    rows += [(100, ["p", "q"] * 20, None), (100, ["p", "q"] * 20, None)]
    total, records = Counter(), Counter()
    for _, herbs, diseases in rows[:-1]:
        for field, terms in (("herbs", herbs), ("diseases", diseases)):
            terms = [t.strip() for t in terms or []]
            grams = [(field, n, " ".join(terms[i : i + n])) for n in range(1, len(terms) + 1) for i in range(len(terms) - n + 1)]
            total.update(grams)
            records.update(set(grams))
    df = spark.createDataFrame(rows, "id long, herbs array<string>, diseases array<string>")
    got = term_counts.gram_counts(df, "id", ["herbs", "diseases"]).collect()
    assert {(r.field, r.size, r.term): (r.total, r.records) for r in got} == {g: (n, records[g]) for g, n in total.items()}
    assert len(got) == len(total) and max(r.size for r in got) == 40


def test_pairs_never_seen_together_are_tests(spark):
    """Benjamini-Hochberg over all pairs of items, against a sorted list with p = 1 for the pairs that no record has."""
    dice = random.Random(8)
    rows = [(i, [f"c{i % 30}", f"c{(i * 7 + dice.randrange(2)) % 30}"] + (["u", "v"] if i % 40 == 0 else []) + (["s", "t"] if i % 100 == 1 else [])) for i in range(400)]
    rows += [(1000 + i, [f"lone{i}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    items = len({t for _, tags in rows for t in tags})
    for rate in (0.01, 0.2):
        got = together.discovered(together.surprising_pairs(df, "id", ["tags"]), rate).collect()
        m = items * (items - 1) // 2
        p = sorted([10**r.log10_p for r in got] + [1.0] * (m - len(got)))
        limit = max([v for k, v in enumerate(p, 1) if v <= rate * k / m], default=-1)
        narrow = max([v for k, v in enumerate(p[: len(got)], 1) if v <= rate * k / len(got)], default=-1)
        flagged = sum(r.discovery for r in got)
        assert flagged == sum(10**r.log10_p <= limit for r in got) < sum(10**r.log10_p <= narrow for r in got)
        assert flagged > 0
    # Limits drop rows and tests stay.
    assert {r.tests for r in together.surprising_pairs(df, "id", ["tags"], min_records=4).collect()} == {m}


def test_common_words_are_counted_over_all_documents(spark, monkeypatch):
    """Words that are usual in small letters, but in no document of the sample; names with a few slips in many uses; addresses in small letters."""
    rows = [(i, f"Every jar of fennel {i} was put away by Quillon near the door. Write to bartov.x@mail.example today.") for i in range(300)]
    rows += [(300 + i, "we met quillon there") for i in range(4)] + [(304, "Fennel is sweet. Bartov said so."), (305, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    people = spark.createDataFrame([("Mirandri Valdovik",), ("Corandri Feldovik",)], "full_name string")
    words = {r.word for r in private.common_words(df, "text").collect()}
    assert {"fennel", "every", "door"} - words == {"every"} and not {"quillon", "bartov"} & words
    monkeypatch.setattr(private, "SAMPLE", 2)
    fits = []
    whole = private.fitted
    monkeypatch.setattr(private, "fitted", lambda *a, **k: fits.append(whole(*a, **k)) or fits[-1])
    want = sorted(map(str, private.found_in(df, people).collect()))
    assert len(want) == len(rows) and {w for w, b in fits[0].known.items() if b & private.COMMON} == words
    # Joined instead of broadcast.
    monkeypatch.setattr(private, "WORDS", 0)
    monkeypatch.setattr(private, "CHUNK", 16)
    assert sorted(map(str, private.found_in(df, people).collect())) == want and any("kind='email'" in r for r in want)


def test_titles_of_all_sources(spark, monkeypatch):
    """A running head of a book that no sampled text comes from, in a text of another book."""
    plain = "every warm root often steadies\nbitter chill before evening meal\nwhile mother strength throughout"
    rows = [(str(i), "blue-river-vol1", plain) for i in range(50)] + [("other", "green-mountain-vol1", plain)]
    rows += [("head", "blue-river-vol1", plain.replace("\nwhile", "\nGREEN MOUNTAIN\nwhile"))]
    monkeypatch.setattr(scan_repair, "SAMPLE", 1)
    got = {r.id: set(r.kinds) for r in scan_repair.structured(spark.createDataFrame(rows, "chunk_id string, source string, text string"))[0].collect()}
    assert got["head"] == {"header"} and not got["other"]
