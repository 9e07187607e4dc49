"""Every operator on empty tables, nulls, blanks, repeated rows and extra columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

from lexmill.llm import encode, mixture, near_copies, pieces, private, scan_repair, term_counts, together, unify

CLASHES = "id n item key word body raw form cls sketches kinds text2 start end at next words term total records use dup suffix positions ids mix_name copies bucket order found kind".split()
SENTENCE = "The warm root of this leaf often steadies every bitter chill before the evening meal and then rests until the voice is firm again"


def wide(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def chunks(spark):
    text = " ".join(SENTENCE.replace("root", w) + "." for w in ("root", "stem", "bark", "wick"))
    tags = (["Vata ", None, "", "vata", "b"], ["c", "b"], None)
    rows = [("a", "s-vol1", text, *tags), ("a", "s-vol1", text, *tags), ("b", None, text, [], None, ["b"]), ("c", "t-vol1", None, None, None, None), ("d", "t-vol1", "", None, ["x"], None), ("e", "t-vol1", " \n ", ["b"], ["x", "x"], None), (None, None, None, None, None, None)]
    rows += [("f", "t-vol2", "word " * 30_000, ["z"], ["z"], ["z"]), ("g", "t-vol1", text.replace("bitter", "sour"), ["b"], ["c"], None)]
    schema = "chunk_id string, source string, text string, herbs array<string>, diseases array<string>, doshas_mentioned array<string>"
    return wide(spark.createDataFrame(rows, schema))


FIELDS = ["herbs", "diseases", "doshas_mentioned"]


def run(df):
    return [tuple(r) for r in df.collect()]


def test_together(chunks):
    rows = {(r.item_a, r.item_b): r for r in together.discovered(together.surprising_pairs(chunks, "chunk_id", FIELDS)).collect()}
    assert rows["diseases:c", "herbs:b"].n_ab == 2 and rows["diseases:c", "herbs:b"].n_a == 2 and rows["diseases:c", "herbs:b"].n_b == 3
    assert all(r.n == 8 and r.expected > 0 and r.log10_p <= 0 for r in rows.values())
    assert run(together.discovered(together.surprising_pairs(chunks.limit(0), "chunk_id", FIELDS))) == []


def test_terms(chunks):
    rows = {(r.field, r.term): (r.total, r.records) for r in term_counts.gram_counts(chunks, "chunk_id", ["herbs", "diseases"]).collect()}
    assert rows["herbs", "vata"] == (2, 1) and rows["herbs", "vata vata b"] == (1, 1) and rows["diseases", "x"] == (3, 2) and rows["diseases", "x x"] == (1, 1)
    assert run(term_counts.gram_counts(chunks.limit(0), "chunk_id", ["herbs"])) == []


def test_pieces(chunks):
    rows = pieces.split_texts(chunks, "chunk_id", "text").orderBy("piece").collect()
    assert {r.id for r in rows} == {"f"} and rows[0].start == 0 and rows[-1].end == 30_000
    assert all(r.end - r.start <= 1024 for r in rows) and all(0 <= a.end - b.start <= 128 and b.start > a.start for a, b in zip(rows, rows[1:]))
    assert run(pieces.split_texts(chunks.limit(0), "chunk_id", "text")) == []
    bare = pieces.split_texts(chunks, "chunk_id", "text", 800, 0).orderBy("piece").collect()
    assert [r.start for r in bare] == [0, *[r.end for r in bare[:-1]]] and bare[-1].end == 30_000 and all(r.end - r.start <= 800 for r in bare)


def test_unify(spark, chunks):
    rows = unify.unified(chunks, "chunk_id", "text").collect()
    assert len(rows) == chunks.count() and {r.id: r.body for r in rows}["c"] is None and {r.id: r.body for r in rows}["d"] == ""
    assert run(unify.same_look(chunks, "chunk_id", "text")) == []
    assert run(unify.same_look(chunks.limit(0), "chunk_id", "text")) == []


def test_near_copies(spark, chunks):
    body = chunks.drop("body").withColumnRenamed("text", "body").drop("id").withColumnRenamed("chunk_id", "id")
    assert sorted(run(near_copies.similar_pairs(near_copies.sketched(body)))) == [("a", "b"), ("a", "g"), ("b", "g")]
    members, links = near_copies.similar_classes(near_copies.sketched(body))
    got = {r.id: r for r in near_copies.groups(members, links).collect()}
    assert got["a"].grp == got["b"].grp == got["g"].grp != got["f"].grp and got["a"].cls == got["b"].cls and got["g"].n_links == 1 and got["f"].n_links == 0
    assert run(near_copies.similar_pairs(near_copies.sketched(body.limit(0)))) == []


def test_repair(chunks):
    rows = scan_repair.repaired(chunks).collect()
    assert len(rows) == chunks.count() and all(r.kinds == [] for r in rows)
    assert {r.id: r.body for r in rows}["c"] is None
    assert run(scan_repair.repaired(chunks.limit(0))) == []


def test_encode(spark):
    docs = wide(spark.createDataFrame([(1, "Hello  world <|endoftext|>\n\tx"), (2, None), (3, ""), (4, " 　"), (5, "ಕ್ಷ 🌿 a" * 2000), (6, "Hello  world <|endoftext|>\n\tx")], "doc_id long, text string"))
    got = {r.id: list(r.ids) for r in encode.token_ids(docs, "doc_id", "text").collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encode.RANKS.replace(".tiktoken", ".json"))
    whole.encode_special_tokens = True
    assert got == {r.doc_id: whole.encode(r.text, add_special_tokens=False).ids if r.text else [] for r in docs.select("doc_id", "text").collect()}
    back = {r.id: r.text for r in encode.decoded(encode.token_ids(docs, "doc_id", "text"), spark).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert {r.id: r.n_tokens for r in encode.token_totals(docs, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert run(encode.token_ids(docs.limit(0), "doc_id", "text")) == []


def test_mixture(spark):
    sizes = wide(spark.createDataFrame([(i, [" Big", "small ", None, "none"][0 if i < 60 else 1 if i < 63 else 2 if i < 70 else 3], 0 if i % 20 == 19 else 5 + i % 7) for i in range(80)], "id long, source string, n_tokens long"))
    plans = wide(spark.createDataFrame([("m", 300), ("none", 10)], "mix_name string, budget_tokens long"))
    targets = wide(spark.createDataFrame([("m", "big", 0.5, 1), ("m", "Small", 0.4, 4), ("m", "lost", 0.1, 9), ("m", None, 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int"))
    rows = mixture.mixed(sizes, plans, targets, buckets=8).collect()
    by = {}
    for r in rows:
        assert 1 <= r.copies <= {"big": 1, "Small": 4}[r.source]
        by[r.source] = by.get(r.source, 0) + r.copies * r.n_tokens
    assert 150 - 11 <= by["big"] <= 150
    held = {r.source: (r.tokens, r.short) for r in mixture.available(sizes, plans, targets).collect()}
    small = held["Small"][0]
    assert held["Small"][1] == (4 * small < 120) and by["Small"] == (4 * small if 4 * small < 120 else by["Small"]) and held["lost"] == (0, True)
    assert {r.source: r.actual_tokens for r in mixture.report(sizes, plans, targets).collect() if r.source} == {"big": by["big"], "Small": by["Small"], "lost": 0}
    assert run(mixture.mixed(sizes.limit(0), plans, targets)) == [] and run(mixture.mixed(sizes, plans, targets.limit(0))) == []
    whole = mixture.mixed(sizes, plans, targets, buckets=1).select("mix_name", "source", "id", "copies")
    assert sorted(run(whole)) == sorted((r.mix_name, r.source, r.id, r.copies) for r in rows)


def test_private(spark):
    people = wide(spark.createDataFrame([(1, "Mirandri Valdovik"), (2, "Corandri Feldovik"), (3, None), (4, "Mirusha Feldomar"), (5, "Corusha Valdomar")], "person_id long, full_name string"))
    docs = wide(spark.createDataFrame([(1, "Write to mirandri.v@mail.example today. Call +91 55500 12345 before noon."), (2, None), (3, ""), (4, " "), (5, "Batch no. 0724671144 was discarded.")], "doc_id long, text string"))
    rows = {r.id: r for r in private.redacted(private.found_in(docs, people)).collect()}
    assert len(rows) == 5 and rows[2].text is None and rows[3].text == "" and rows[4].text == " "
    assert private.found_in(docs.limit(0), people).count() == 0
    assert private.found_in(docs, people.limit(0)).count() == 5
