"""Operators on small fixtures: edge cases and brute force."""

import json
import uuid
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.numerals import parse_numeral, parse_ordinal, parse_roman, roman
from lexmill.functions.ranking import numbered
from lexmill.operators import dates, lookups, records, retrieval, review, segments, tagging
from lexmill.sources import files, sinks


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(column(F.col("v"))).collect()]


def test_fold_and_lines(spark):
    assert one(spark, T.fold, "Vāta", "Ａbc", None, "café") == ["vata", "abc", None, "cafe"]
    assert one(spark, T.lines, "a\r\nb\x0bc\u2028d\n", "") == [["a", "b", "c", "d"], []]
    assert one(spark, T.spoken, "Vata, vatavarana Pitta KAPHA") == ["vaata, vatavarana pitta kaafa"]


def test_numerals(spark):
    assert one(spark, parse_roman, "XVI.", "VL.", "LIL", "I. THE ORIGIN", "Í", "") == [16, None, None, 1, 1, None]
    assert one(spark, parse_numeral, "1V", "1X", "10", "201", "II") == [4, 9, 10, None, 2]
    assert one(spark, parse_ordinal, "twenty-first", "the forty ninth", "fiftieth") == [21, 49, None]
    assert len({roman(n) for n in range(1, 200)}) == 199


def test_noise_and_cleaning(spark):
    assert one(spark, segments.is_noise, "", "12 | xiv", "al", "CHAPTER IV", "true text") == [True, True, True, True, False]
    assert one(spark, segments.cleaned, "herb-\nalist oil", "Vata- \nPitta", "agni -- fire") == ["herbalist oil", "Vata-Pitta", "agni—fire"]
    assert one(spark, lambda c: segments.marker_parts(c, "Three signs"), "a. Three signs b", "Three signs x") == [["a.", "Three signs b"], ["Three signs x"]]


def merged(sizes, least=100):
    out, lead = [], 0
    for n in sizes:
        if out and n < least:
            out[-1] += n
        elif not out and lead + n < least:
            lead += n
        else:
            out.append(n if out else lead + n)
            lead = 0
    return out + [lead] if lead or not out else out


def batched(sizes, limit, most):
    out, total, n, b = [], 0, 0, 0
    for s in sizes:
        if n and (total + s > limit or n >= most):
            b, total, n = b + 1, 0, 0
        total, n = total + s, n + 1
        out.append(b)
    return out


def test_folds_against_loops(spark):
    import random

    dice = random.Random(3)
    cases = [[5], [5, 5], [5, 500], [500, 5], [5, 5, 500, 5, 5, 200], *[[dice.choice([3, 40, 99, 100, 700, 18001]) for _ in range(dice.randrange(1, 30))] for _ in range(20)]]
    df = spark.createDataFrame([(g, i, n, "w") for g, c in enumerate(cases) for i, n in enumerate(c)], "g int, i int, n int, t string")
    got = {}
    for r in segments.merged_fragments(df, ["g"], "i", "n", "t", 100).orderBy("g", "place").collect():
        got.setdefault(r.g, []).append(r.n_tokens)
    assert got == {g: merged(c) for g, c in enumerate(cases)}
    got = {}
    for r in segments.batches(df, ["g"], "i", "n", 18000, 20).orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.batch)
    assert got == {g: batched(c, 18000, 20) for g, c in enumerate(cases)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.dates(date(1990, 1, 1), date(2040, 1, 1)), st.integers(-9, 60)), min_size=1, max_size=20))
def test_weekdays(spark, pairs):
    df = spark.createDataFrame([(i, a, a + timedelta(n)) for i, (a, n) in enumerate(pairs)], "i int, a date, b date")
    got = df.orderBy("i").select(dates.weekdays_between(F.col("a"), F.col("b")).alias("n"), dates.next_weekday(F.col("a")).alias("d")).collect()
    for (a, n), r in zip(pairs, got):
        assert r.n == sum((a + timedelta(k)).weekday() < 5 for k in range(max(n, 0)))
        assert r.d.weekday() < 5 and 0 <= (r.d - a).days <= 2


def test_point_ids(spark):
    space = uuid.uuid5(uuid.NAMESPACE_URL, "x/y")
    names = ["", "a", "ch01-002", "ā"]
    assert one(spark, lambda c: records.point_id(c, space), *names) == [str(uuid.uuid5(space, n)) for n in names]


def test_upsert_and_numbers(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("a", 2, "z")], "k string, v int, t string")
    assert sorted(map(tuple, records.upserted(df, "k", "v").collect())) == [("a", 2, "z"), ("b", 1, None)]
    rows = numbered(spark.range(1000).withColumn("k", F.xxhash64("id")), "k").orderBy("k").collect()
    assert [r.row_no for r in rows] == list(range(1000))


def test_publish_and_replace(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for version, n in (("v1", 1), ("v2", 2)):
        records.publish(df.limit(n), spark, str(tmp_path), "live_index", version)
        assert spark.table("live_index").count() == n
    with pytest.raises(Exception):
        records.publish(df, spark, str(tmp_path), "live_index", "v2")
    fresh = spark.createDataFrame([("a", 9)], "k string, v int")
    again = sinks.replace_columns(sinks.replace_columns(df, fresh, "k"), fresh, "k")
    assert sorted(map(tuple, again.collect())) == [("a", 9), ("b", 2)]


def test_retrieval_small(spark):
    docs = spark.createDataFrame([(1, "milk and honey"), (2, "milk"), (3, None), (4, ""), (5, "ghee")], "id long, text string")
    asked = spark.createDataFrame([(7, "milk milk honey"), (8, None), (9, "nothing here")], "query_id long, text string")
    hits = retrieval.bm25(docs, "id", "text", asked, 5).orderBy("rank").collect()
    assert [(r.query_id, r.id, r["rank"]) for r in hits] == [(7, 1, 0), (7, 2, 1)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 2.0])], "id long, v array<float>")
    near = retrieval.cosine(vectors, "id", "v", vectors.where("id = 1").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in near] == [(1, 1.0), (2, 1.0)]
    both = retrieval.fused(retrieval.bm25(docs, "id", "text", asked, 5), retrieval.bm25(docs, "id", "text", asked, 5), k=1).collect()
    assert [(r.id, r.score) for r in both] == [(1, 1.0)]
    empty = docs.limit(0)
    assert retrieval.bm25(empty, "id", "text", asked, 5).count() == 0


def test_tags_small(spark):
    vocabulary = spark.createDataFrame([("doshas", "vata", "vata"), ("doshas", "pitta", "pitta"), ("d", "prameha", "meha")], "category string, canonical string, form string")
    texts = spark.createDataFrame([(1, "Vāta rises"), (2, "vata-pitta"), (3, "mehas"), (4, "vatavarana"), (5, None), (6, "dvandvaja of vata and pitta"), (7, "dvandvaja vata")], "id int, text string")
    tags = tagging.tagged(texts, "id", "text", vocabulary)
    assert sorted((r.id, r.canonical) for r in tags.collect()) == [(1, "vata"), (2, "pitta"), (2, "vata"), (3, "prameha"), (6, "pitta"), (6, "vata"), (7, "vata")]
    found = tagging.combinations(texts, "id", "text", tags, ["vata", "pitta", "kapha"], ["dvandvaja"], ["tridosha"])
    assert sorted(map(tuple, found.collect())) == [(2, "vata-pitta"), (6, "vata-pitta")]


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"x\xff\n")
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert sorted(map(tuple, files.volumes(spark, str(tmp_path)).collect())) == [("a", "one\ntwo"), ("b", "x�\n")]
    for name, body in (("d1", json.dumps({"status": "DRAFT"})), ("d2", "{broken")):
        (tmp_path / "docs" / name).mkdir(parents=True)
        (tmp_path / "docs" / name / "manifest.json").write_text(body)
    from pyspark.sql.types import StringType, StructField, StructType

    got = files.json_documents(spark, str(tmp_path / "docs"), StructType([StructField("status", StringType())]))
    assert [tuple(r) for r in got.select("dir", "status").collect()] == [("d1", "DRAFT")]
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    sinks.write_json_lines(df, str(tmp_path / "out"), append=True)
    assert files.json_lines(spark, str(tmp_path / "out"), "k string, n int").count() == 2
    ranges = files.page_ranges(spark.createDataFrame([("v", 31), ("w", 0)], "s string, n int"), "s", "n").orderBy("part").collect()
    assert [r.part_name for r in ranges] == ["v_part001_p0001-0015", "v_part002_p0016-0030", "v_part003_p0031-0031"]


def test_folders_and_collections(spark, tmp_path):
    for name, body in (("d1", ["manifest.json", "script.json"]), ("d2", ["manifest.json"]), ("d3", ["script.json", "manifest.json", "reel.mp4"])):
        (tmp_path / "runs" / name).mkdir(parents=True)
        for f in body:
            (tmp_path / "runs" / name / f).write_text("{}")
    got = files.artifact_folders(spark, str(tmp_path / "runs"), ["manifest.json", "script.json"]).collect()
    assert sorted((r.dir, r.files) for r in got) == [("d1", ["manifest.json", "script.json"]), ("d3", ["manifest.json", "reel.mp4", "script.json"])]
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int")
    sinks.write_json_documents(df, "k", str(tmp_path / "docs"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "docs")).collect()) == ['{"n":1}', '{"n":2}', '{"n":3}']
    assert [r.k for r in files.pending(df, df.where("k = 'a'"), "k", 1).collect()] == ["b"]
    path = str(tmp_path / "index")
    assert records.ensured(spark, path, "k string, n int").count() == 0
    df.write.mode("append").parquet(path)
    assert records.ensured(spark, path, "k string, n int").count() == 3 and records.ensured(spark, path, "k string, n int", force=True).count() == 0
    rows, dim = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), spark.createDataFrame([("a", 7), ("b", 8), ("c", 9), ("c", 9)], "k string, v int")
    assert sorted((r.i, r.v) for r in lookups.required(rows, dim, "k").collect()) == [(1, 7), (2, 8)]
    for wrong in ("c", "z", None):
        with pytest.raises(Exception, match="stands"):
            lookups.required(spark.createDataFrame([(1, wrong)], "i int, k string"), dim, "k").collect()
    with pytest.raises(Exception, match="single"):
        lookups.one_per(dim, "k").collect()


def test_cleaning(spark):
    cases = {
        "herb-\nalist oil is warm": "herbalist oil is warm", "of Vata- \nPitta kind": "of Vata-Pitta kind", "agni -- fire and a--b--c": "agni—fire and a—b—c", "A u thoritative verse of it": "Authoritative verse of it",
        "the herb-\nal\nalist oil": "the herbalist oil", "named :- the root": "named :— the root", "CHAPTER IV. The root": "The root", "12 | 14\nroot of • it\nUNIVERSITY OF X\nthus ends the first": "root of it", " . . root": "root", "": "", "•\n12, 14": "",
    }
    got = one(spark, segments.cleaned, *cases)
    assert dict(zip(cases, got)) == cases
    assert one(spark, lambda c: segments.cleaned_2(c), "CHAPTER I. Root\nNIDANASTHANA.\n12\n?!\nChapter 2 - stem\n========== p1 ==========") == ["Root\nstem\n========== p1 =========="]
    assert one(spark, lambda c: segments.cleaned_2(c, separators=False), "root\n========== p1 ==========\nstem") == ["root\nstem"]
    assert one(spark, segments.role_by_opening, "Metrical text: a", "Now we shall describe", "x", None) == ["verse_summary", "topic", "prose", "prose"]


def test_drafts(spark):
    schema = "artifact_dir string, status string, generated_at string, pillar string, label string, season struct<label string>, artifacts struct<script string, reel string>"
    good = ("d1", "DRAFT - x", "2025-03-03T04:00:00+00:00", None, None, ("Mist",), ("s", "r"))
    rows = [good, good, ("d2", "DRAFT", "yesterday", None, None, None, ("s", "r")), ("d3", "approved", good[2], None, None, None, ("s", "r")), ("d4", "DRAFT", good[2], "dosha", None, None, ("s", "r")), ("d5", "DRAFT", good[2], None, "x", None, ("s", None))]
    got = review.drafts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.artifact_dir, str(r.day), r.pillar, r.label) for r in got) == [("d1", "2025-03-03", "seasonal", "Mist"), ("d4", "2025-03-03", "dosha", "d4")]


def test_sections_and_lookback(spark):
    import random

    dice = random.Random(5)
    cases = [[dice.choice("abc") for _ in range(dice.randrange(1, 12))] for _ in range(30)]
    hints = spark.createDataFrame([(v, i, s) for v, c in enumerate(cases) for i, s in enumerate(c)] + [(0, 99, None)], "v int, i int, s string")
    got = {}
    for r in segments.one_way_sections(hints, "v", "i", "s").orderBy("volume", "start").collect():
        got.setdefault(r.volume, []).append((r.section, r.start))
    for v, case in enumerate(cases):
        seen, now, want = set(), None, []
        for i, s in enumerate(case):
            if s != now and s not in seen:
                now = s
                seen.add(s)
                want.append((s, i))
        assert got[v] == want
    lines = spark.createDataFrame([("t", i, "x" if i in (2, 30) else None) for i in range(40)], "id string, line_no int, m string")
    seen = {r.line_no for r in segments.lookback(lines, F.col("m")).where("seen = 'x'").collect()}
    assert seen == {*range(3, 13), *range(31, 40)}


def test_evaluated(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "query_id int, id string, rank int")
    wanted = spark.createDataFrame([(1, "b"), (1, "z"), (3, "q")], "query_id int, id string")
    assert sorted(map(tuple, retrieval.evaluated(hits, wanted).collect()), key=str) == [(1, 2, 2, 1, 1), (3, 0, 1, 0, None)]


def test_tables_without_rows(spark):
    texts = spark.createDataFrame([], "id string, text string, source string")
    vocabulary = spark.createDataFrame([], "category string, canonical string, form string")
    tags = tagging.tagged(texts, "id", "text", vocabulary)
    assert tags.count() == tagging.coverage(texts, "id", tags, vocabulary).count() == 0
    assert tagging.untagged(texts, "id", tags).first().share is None
    assert numbered(texts.select("id"), "id").count() == 0
    assert files.stitched(texts, "source", "id", "id", "text").count() == 0
