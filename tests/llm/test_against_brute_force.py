"""Operators whose results SQL cannot give on whole tables, against brute force, round trips and planted cases on small data."""

import random
import unicodedata as ud
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import boost, near_copies, pieces, private, queries, scan_repair, together, unify

FOLDER = "/root/testdata/sf0.001"


def test_oracles(spark):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, FOLDER)
        want = con.execute(sql).df()[got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r)) for r in want.astype(object).values.tolist()), name


def test_tail_is_close_to_the_exact_one():
    dice = np.random.default_rng(2)
    y, number = dice.uniform(0.1, 2, 5), dice.integers(5, 60, 5).astype(float)
    for xa, xb, seen in ((0.2, 0.3, 12), (0.05, 0.1, 4), (0.5, 0.5, 40), (0.1, 0.1, 1)):
        q = np.repeat((xa * y / (1 + xa * y)) * (xb * y / (1 + xb * y)), number.astype(int))
        p = np.zeros(len(q) + 1)
        p[0] = 1
        for v in q:
            p[1:] = p[1:] * (1 - v) + p[:-1] * v
            p[0] *= 1 - v
        mean, tail = together.upper_tail(np.array([float(seen)]), np.array([xa]), np.array([xb]), y, number)
        assert mean[0] == pytest.approx(q.sum())
        assert tail[0] == pytest.approx(np.log10(p[seen:].sum()), abs=0.06)


def test_null_keeps_both_margins():
    items, sizes = [(3, 4), (10, 2), (25, 1)], [(1, 20), (3, 9), (5, 2)]
    x, y, miss = together.fitted_null(items, sizes)
    assert miss < 1e-5
    for (f, _), a in zip(items, x):
        assert sum(n * a * b / (1 + a * b) for (_, n), b in zip(sizes, y)) == pytest.approx(f, rel=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c,", "d\n\n", "e"]), min_size=1, max_size=400), st.integers(20, 60))
def test_cuts_cover_every_word(words, limit):
    text = " ".join(words)
    at, rank, _ = pieces.boundaries(text, 5)
    end, nxt = pieces.successors(at, rank, limit, 5)
    where = {int(a): k for k, a in enumerate(at)}
    k, covered = 0, 0
    while True:
        assert at[k] <= covered and end[k] - at[k] <= limit and covered - at[k] <= 5
        covered = int(end[k])
        if nxt[k] < 0:
            break
        assert nxt[k] > at[k]
        k = where[int(nxt[k])]
    assert covered == len(text.split())


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_words(text):
    assert [w.decode() for w in near_copies.words_of(text)] == near_copies._word.findall(text.lower())


def test_similarity_against_sets():
    dice = random.Random(4)
    for _ in range(300):
        a = [dice.choice("abcdefghijkl") for _ in range(dice.randrange(3, 60))]
        b = list(a)
        for _ in range(dice.randrange(0, 12)):
            b[dice.randrange(len(b))] = dice.choice("abcxyz")
        if dice.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        sa, sb = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
        true = len(sa & sb) / len(sa | sb) if a != b else 1.0
        assert (near_copies.similarity(a, b, 0.6) > 0.6) == (true > 0.6)


def test_pairs_against_brute_force(spark):
    got = {tuple(r) for r in queries.p5_found(spark, FOLDER).collect()}
    texts = {r.id: near_copies._word.findall((r.body or "").lower()) for r in queries._flat(spark, FOLDER).collect()}
    sets = {i: set(zip(w, w[1:], w[2:])) for i, w in texts.items() if w}
    want = {(a, b) for a in sets for b in sets if a < b and (texts[a] == texts[b] or len(sets[a] & sets[b]) > 0.6 * len(sets[a] | sets[b]))}
    assert got == want and want


def test_crowds_lose_no_pair(spark, monkeypatch):
    """Boilerplate in every text, so that all buckets are crowds."""
    dice = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    plate = [dice.choice(words) for _ in range(60)]
    base = [plate + [dice.choice(words) for _ in range(80)] for _ in range(60)]
    rows = [(2 * i, " ".join(t)) for i, t in enumerate(base)] + [(2 * i + 1, " ".join(t[:100] + ["edit"] + t[101:])) for i, t in enumerate(base)]
    monkeypatch.setattr(near_copies, "CROWD", 1)
    got = {tuple(r) for r in near_copies.similar_pairs(near_copies.sketched(spark.createDataFrame(rows, "id long, body string"))).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(60)}


def test_same_look_against_brute_force(spark):
    got = {tuple(r) for r in queries.p4_found(spark, FOLDER).collect()}
    rows = {r.chunk_id: r.text for r in spark.read.parquet(f"{FOLDER}/all_chunks.parquet").collect() if r.text and r.text.strip()}

    def look(t):
        t = "".join(unify.LOOKS.get(c, c) for c in ud.normalize("NFKC", t) if ud.category(c) != "Cf")
        return ud.normalize("NFC", t).replace("‐", "-").replace("\r\n", "\n")

    by = defaultdict(list)
    for i, t in rows.items():
        by[look(t)].append(i)
    assert got == {(min(a, b), max(a, b)) for v in by.values() for a in v for b in v if a < b and rows[a] != rows[b]}


def test_visible_differences_stay():
    for t in ("10⁻³ x² ½", "Vāta é", "a  b", "κολύραντα бурвица ॐ", "क‍ष", "line\nline"):
        assert unify.base_form(t) == t and unify.looks_latin(t) == t
    assert unify.looks_latin("Ｆｕｌｌ ﬁt 𝗌𝗈 раѕte Тһе a​b x y") == "Full fit so paste The ab x y"


def test_scan_noise_planted(spark):
    """Noise of every kind planted in clean text: what is found and how well it is repaired."""
    dice = random.Random(9)
    vocabulary = "every warm root often steadies bitter chill before evening meal while mother strength throughout harvest complexion gathers another morning powder softens vessel".split()
    rows, truth, clean = [], {}, {}
    for i in range(400):
        words = [dice.choice(vocabulary) for _ in range(60)]
        text = " ".join(words) + "."
        kinds, noisy = set(), words[:]
        if i % 4 == 1:
            k = dice.randrange(60)
            w = noisy[k]
            options = [(a, b) for a, b in scan_repair.MISREAD if a in w and not b.isalpha()]
            if options:
                a, b = dice.choice(options)
                noisy[k] = w.replace(a, b, 1)
                kinds.add("glyph")
        lines = [" ".join(noisy[k : k + 9]) for k in range(0, 60, 9)]
        if i % 4 == 2:
            w = lines[2].split()[0]
            lines[1], lines[2] = lines[1] + " " + w[:2] + "-", w[2:] + lines[2][len(w) :]
            kinds.add("hyphen")
        if i % 4 == 3:
            lines.insert(3, f"{100 + i} BLUE RIVER")
            kinds |= {"header", "page_no"}
        rows.append((str(i), "blue-river-vol1", "\n".join(lines) + "."))
        truth[str(i)], clean[str(i)] = kinds, text
    got = {r.id: r for r in scan_repair.repaired(spark.createDataFrame(rows, "chunk_id string, source string, text string")).collect()}
    assert sum(set(got[i].kinds) == truth[i] for i in truth) >= 0.97 * len(truth)
    assert sum(got[i].body == clean[i] for i in truth) >= 0.95 * len(truth)
    # The joined path gives what the broadcast path gives.
    small, scan_repair.SMALL = scan_repair.SMALL, 0
    try:
        again = {r.id: (r.body, r.kinds) for r in scan_repair.repaired(spark.createDataFrame(rows, "chunk_id string, source string, text string")).collect()}
    finally:
        scan_repair.SMALL = small
    assert again == {i: (r.body, r.kinds) for i, r in got.items()}


def test_compounds_and_lists_stay():
    model = scan_repair.Lines.fitted([("blue-river-vol1", "12 BLUE RIVER\nsome words that go on and on here\nand more of them follow on the line")])
    text = "1. The mixed kind is called Vata-\nPitta by all.\n2. A hand-ground salve ॥ 12 ॥"
    body, kinds = scan_repair.structure(text, "blue-river-vol1", model)
    fixed, more = scan_repair.repair(body, {})
    assert not kinds and not more and "hand-ground" in fixed and "\n2. " in fixed and "॥ 12 ॥" in fixed


def test_boosted_trees_learn():
    dice = np.random.default_rng(0)
    x = dice.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_private_held_out(spark):
    """Fitted on all documents but those tested; stretches planted by rule must be found, traps must not."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    people = [r.full_name for r in spark.read.parquet("/root/testdata/sf0.01/clinic_people.parquet").collect()]
    field = private.fitted(docs[:900], people)
    given, last = people[3].split()
    cases = [
        (f"my name is {given} {last} and I have a question", {"name"}), (f"Thanks to Dr. {last} for the notes.", {"name"}), ("Call +91 55500 11122 before noon.", {"phone"}),
        ("Write to someone.else@mail.example for the full recipe.", {"email"}), ("Visit us at 12/3 Copper Street, Drumakere - 044 827.", {"address"}), ("The form showed MRN 20304766, checked at the desk.", {"id_number"}),
        ("Batch no. 0724671144 was discarded.", set()), ("Ask your Dr. before you begin.", set()), ("Lot 3191-2286 passed the taste test.", set()), ("Revised on 12/01/2014.", set()), ("Three drops @ dawn, two @ dusk.", set()),
    ]
    pages = field.pages([t for t, _ in cases])
    labels = private.labelled(pages, field)
    for k, (text, want) in enumerate(cases):
        assert {kind for _, _, kind in private.stretches(text, pages, k, labels)} == want, text
    rest = field.pages(docs[900:])
    labels = private.labelled(rest, field)
    counts = Counter(kind for k, t in enumerate(docs[900:]) for _, _, kind in private.stretches(t, rest, k, labels))
    assert sum(counts.values()) > 0


def test_names_and_places_of_no_table(spark):
    """Names and addresses whose parts are in neither the people table, the cue lists nor the documents. The measured shares are in the README."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text][: private.SAMPLE]
    people = [r.full_name for r in spark.read.parquet("/root/testdata/sf0.1/clinic_people.parquet").collect()]
    field = private.fitted(docs, people)
    names = "John Smith,Zhang Wei,Priya Natarajan,Nguyen Thi Minh,Maria Gonzales,Anita Desai,Omar Haddad,Lucy Brown,Kofi Mensah,Ingrid Larsen,Pedro Alvarez,Meera Iyer".split(",")
    places = "14 Elm Drive, Springfield 560001|221B Baker Crescent, London 560034|Flat 4, Rose Villa, Mysore 570001|No. 17, Hilltop Terrace, Pune 411001|9 Orchard Close, Bath 001223|Plot 88, Lotus Enclave, Kochi 682 001|36/2 Harbour View, Dover 004411".split("|")
    around = ["Thanks to {} for the notes.", "Patient: {}, aged 44.", "my name is {} and I have a question", "Seen by {} on the second visit.", "The letter came from Dr. {} today.", "Referral: {}, MRN 51793135, seen before noon."]
    where = ["Home address: {}", "Deliver to Mrs. Anita Desai, {}", "Please send the jar to {} before the rains."]
    cases = [(a.format(n), n, "name") for n in names for a in around] + [(a.format(n), n, "address") for n in places for a in where]
    pages = field.pages([t for t, _, _ in cases])
    labels = private.labelled(pages, field)
    hit = Counter()
    for k, (text, stretch, kind) in enumerate(cases):
        at = text.index(stretch)
        hit[kind] += any(q == kind and a < at + len(stretch) and at < b for a, b, q in private.stretches(text, pages, k, labels))
    shares = {kind: hit[kind] / sum(q == kind for _, _, q in cases) for kind in ("name", "address")}
    print(shares)
    assert min(shares.values()) >= 0.9, shares
    plain = "The salve is kept in Mysore until Tuesday.|Batch no. 0724671144 was discarded.|Stir it for 12 minutes and rest.|See verse 14 of the second chapter.|Triphala is best when fresh."
    pages = field.pages(plain.split("|"))
    labels = private.labelled(pages, field)
    found = [private.stretches(t, pages, k, labels) for k, t in enumerate(plain.split("|"))]
    assert sum(map(bool, found)) <= 1, found


def test_pair_weights_are_fitted(spark):
    """A bare name takes its label over a skip edge from a titled one; the weights come from the fit."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    people = [r.full_name for r in spark.read.parquet("/root/testdata/sf0.01/clinic_people.parquet").collect()]
    field = private.fitted(docs, people)
    name = private.LABELS.index("name")
    assert field.moves[name, name] > field.moves[name, 0] and field.skip[name, name] > field.skip[name, 0]
