"""p5_found's cheaper ways give what the plain ones give: bounds before sets, packed sketches, tokens looked up once."""

import random
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import near_copies, scan_repair, unify


def test_sets_of_bigrams_are_compared_after_the_bound(spark):
    dice = random.Random(3)
    spell = lambda letters, n: "".join(dice.choice(letters) for _ in range(n))
    words = sorted({spell("aeinrst", dice.randrange(2, 9)) for _ in range(150)} | {"āmaāma", "aaaaaa", spell("abcdefghijklmnopqrstuvwxyzāīū", 200)})
    tokens = sorted({spell("aeinrst1", dice.randrange(2, 10)) for _ in range(250)} | {w[:-1] + "x" for w in words})
    a, b = spark.createDataFrame([(t, 1 + len(t) % 3) for t in tokens], "key string, n long"), spark.createDataFrame([(w, 12 + len(w) % 5) for w in words], "word string, word_n long")
    met = scan_repair.similar_words(a, b)
    plan = met._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "ShuffledHashJoin" in line]
    assert joins and all("bit_count" in x and "array_intersect" not in x for x in joins)
    want = set()
    for t in tokens:
        for w in words:
            n, m = 1 + len(t) % 3, 12 + len(w) % 5
            shared = len(set(scan_repair._grams(t)) & set(scan_repair._grams(w)))
            if m >= scan_repair.RATIO * n and abs(len(t) - len(w)) <= scan_repair.FAR and shared >= max(2, scan_repair.LIKE * (len(w) + 1)):
                want.add((t, n, w, m, shared))
    assert {tuple(r) for r in met.collect()} == want and len(want) > 100


def test_packed_buckets_are_those_of_the_columns(spark):
    dice = random.Random(4)
    texts = [" ".join(f"w{dice.randrange(300)}" for _ in range(dice.choice([1, 4, 20, 60, 90]))) for _ in range(80)]
    texts += [f"{t} {t} {t}" for t in texts[:40]] + [" ".join(["oil"] * 50), "", None]
    rows = near_copies.sketched(spark.createDataFrame(list(enumerate(texts)), "id long, body string")).select(F.col("id").alias("c"), "sketches", "tiny")
    want = {tuple(r) for r in rows.select("c", F.explode(near_copies._buckets(rows)).alias("key")).collect()}
    batches = rows.toArrow().to_batches(max_chunksize=33)
    got = [(int(c), int(k)) for cs, ks in near_copies._keys(iter(batches)) for c, k in zip(cs, ks)]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = lambda found: sorted((int(a), int(b)) for x in found for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist()) if b is not None)
    plain, lots = pairs(near_copies._paired(near_copies._rows(iter(batches)))), {}
    for x in near_copies._dealt(5)(iter(batches)):
        assert x.num_rows <= 5
        for k in range(x.num_rows):
            lots.setdefault(x.column("lot")[k].as_py(), []).append(x.slice(k, 1))
    assert sorted(p for of_lot in lots.values() for p in pairs(near_copies._paired_lots(iter(of_lot)))) == plain and plain
    assert list(near_copies._keys(iter([batches[0].slice(0, 0)])))[0][0].size == 0


def test_a_crowd_told_to_every_task_or_shuffled(spark, monkeypatch):
    """More than CROWD texts share a passage; of them only those that share much more are near copies."""
    dice = random.Random(8)
    stock = [f"s{i}" for i in range(40)]
    texts = [" ".join([*stock, *(f"w{dice.randrange(10**6)}" for _ in range(60))]) for _ in range(200)]
    texts += [f"{t} more" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    found = lambda: {tuple(r) for r in near_copies.similar_pairs(near_copies.sketched(df)).collect()}
    assert found() == {(i, 200 + i) for i in range(20)}
    monkeypatch.setattr(near_copies, "FEW", 0)
    assert found() == {(i, 200 + i) for i in range(20)}


def test_steps_of_misreading():
    @lru_cache(None)
    def steps(a, b):  # (others, known)
        if not a and not b:
            return 0, 0
        ways = [(1, 0, a[1:], b)] if a else []
        ways += [(0 if b[0] in scan_repair.STRAY else 1, 0, a, b[1:])] if b else []
        ways += [(a[0] != b[0], 0, a[1:], b[1:])] if a and b else []
        ways += [(0, 1, a[len(x) :], b[len(y) :]) for x, y in scan_repair.MISREAD if a.startswith(x) and b.startswith(y)]
        return min((o + r[0], k + r[1]) for o, k, x, y in ways for r in [steps(x, y)])

    dice = random.Random(2)
    for _ in range(400):
        a, b = ("".join(dice.choice("abcdehilmnoqrtuvwz0158|@9~") for _ in range(dice.randrange(8))) for _ in range(2))
        assert scan_repair._steps(a, b) == steps(a, b)[::-1]


def test_tokens_of_a_batch_are_looked_up_once():
    looked = []

    class Heads(scan_repair._Heads):
        def __getitem__(self, token):
            looked.append(token)
            return super().__getitem__(token)

    heads = Heads(frozenset({("blue", "river")}))
    texts = ["the BLUE river", None, "", " \n ", "iv the RIVER\x1cXII", "the the the oil"]
    got = heads.held(texts)
    assert len(looked) == len(set(looked)) and got == [heads.of((t or "").split()) for t in texts] and len(set(got)) > 2


def test_words_and_plain_texts():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([" Oil, ĀMA--oil 12 x ", None, " - ", "oil"])], ["id", "body"])
    (got,) = near_copies.sketch(iter([batch]))
    assert got.column("id").to_pylist() == [1, 4] and got.column("words").to_pylist() == ["oil āma oil 12 x", "oil"]
    (none,) = near_copies.sketch(iter([batch.slice(1, 2)]))
    assert none.num_rows == 0 and none.schema == got.schema
    for c in map(chr, range(0x180)):
        text = f"a{c}b"
        if not unify.ODD.search(text):
            assert unify.base_form(text) is text
        elif c.isascii() and c not in "\r\x0b\x0c\x1c\x1d\x1e":
            assert unify.base_form(text) == "ab"
