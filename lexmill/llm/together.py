"""Problem 1: items that stand together in a record, and how far that exceeds chance.

Pair counts are exact. The null is a bipartite configuration model: record r holds item j with probability x_j y_r / (1 + x_j y_r), with x and y
fitted so that every item's expected frequency and every record's expected size equal the observed ones. It has one x for each distinct frequency and
one y for each distinct size, so the fit works on the two histograms. The number of records with both items is then Poisson-binomial; its upper tail
comes from the saddlepoint approximation in its r* form (normal tail at w + log(u / w) / w), within a few per cent of the exact tail at any number of
records, and Benjamini-Hochberg controls false discoveries.

Items are trimmed and lower-cased; null and blank ones are dropped; one in a record counts once. Records are distinct ids; records without items count
in N. Null arrays are empty. Ties in names cannot occur: an item is its field and its term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged


#: The most by which the null may miss an observed frequency or size.
MISS = 0.02


def terms_of(column: str) -> F.Column:
    """The cleaned elements of an array column, repeats kept."""
    clean = F.transform(F.col(column), lambda x: F.lower(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.filter(F.coalesce(clean, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def baskets(records: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """(id, items): one row per distinct id with its sorted distinct items, written `field:term`."""
    def named_terms(field: str) -> F.Column:
        return F.transform(terms_of(field), lambda x: F.concat(F.lit(field + ":"), x))

    named = [named_terms(f) for f in fields]
    return records.dropDuplicates([id]).select(F.col(id).alias("id"), F.array_sort(F.array_distinct(F.concat(*named))).alias("items"))


def fitted_null(items: list[tuple[int, int]], sizes: list[tuple[int, int]], rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """(x, y, miss) for histograms of frequencies and sizes, given as (value, how many). Fixed-point rounds until x changes by less than 1e-8.

    miss: the largest relative difference between an expected and an observed margin that is left. An item that all records hold has no finite x; its
    margin is approached as the rounds go on.
    """
    f, nf = (np.array(c, float) for c in zip(*items))
    k, nk = (np.array(c, float) for c in zip(*sizes))
    total = (f * nf).sum()
    x, y = f / np.sqrt(total), k / np.sqrt(total)
    for _ in range(rounds):
        old = x
        x = f / np.array([(nk * y / (1 + a * y)).sum() for a in x]) if len(x) < 2000 else f / sum(n * b / (1 + x * b) for n, b in zip(nk, y))
        y = k / np.array([(nf * x / (1 + b * x)).sum() for b in y])
        if np.abs(x / old - 1).max() < 1e-8:
            break
    p = x[:, None] * y / (1 + x[:, None] * y) if len(x) * len(y) < 10**7 else None
    miss = 0.0 if p is None else max(np.abs(p @ nk / f - 1).max(), np.abs(nf @ p / k - 1).max())
    return x, y, float(miss)


def _log_normal_tail(z: np.ndarray) -> np.ndarray:
    """Natural log of P(Z > z), by the continued fraction for large z."""
    from math import erfc

    low = np.array([np.log(max(erfc(v / 2**0.5) / 2, 1e-300)) if v < 8 else 0.0 for v in z])
    big = np.maximum(z, 8.0)
    return np.where(z < 8, low, -big * big / 2 - np.log(big * np.sqrt(2 * np.pi)) + np.log1p(-1 / (big * big)))


def upper_tail(seen: np.ndarray, xa: np.ndarray, xb: np.ndarray, y: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected count, log10 of P(count >= seen)) of pairs of items with fitnesses xa and xb; y, records: fitness and number of records by size.

    Saddlepoint with continuity correction; counts at or below expectation get the normal tail, counts of nearly all records the product.
    """
    q = (xa[:, None] * y / (1 + xa[:, None] * y)) * (xb[:, None] * y / (1 + xb[:, None] * y))
    mean = q @ records
    at = np.minimum(seen - 0.5, records.sum() - 0.25)
    t = np.log(np.maximum(at, 1e-9) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = q * np.exp(np.clip(t, -50, 700))[:, None]
        p = e / (1 - q + e)
        slope = (p * (1 - p)) @ records
        step = np.clip((p @ records - at) / np.maximum(slope, 1e-300), -2, 2)
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    k2 = np.maximum(((p * (1 - p)) @ records), 1e-300)
    k1 = np.log1p(q * np.expm1(np.clip(t, -50, 700))[:, None]) @ records
    w = np.sqrt(np.maximum(2 * (t * at - k1), 0))
    u = 2 * np.sinh(np.clip(t / 2, -300, 300)) * np.sqrt(k2)
    with np.errstate(all="ignore"):
        star = w + np.log(u / w) / w
    tail = _log_normal_tail(np.where((t > 1e-4) & np.isfinite(star), star, (at - mean) / np.sqrt(k2)))
    return mean, np.minimum(tail / np.log(10), 0.0)


def surprising_pairs(records: DataFrame, id: str, fields: list[str], min_records: int = 1, min_share: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, expected, log10_p, tests): pairs in at least min_records records and min_share of all; item_a < item_b.

    tests, the same in every row, is the number of pairs of items there are, those never seen together and those below the limits included.
    Items below the two limits cannot be in such a pair and are dropped before pairs are made (they still count in the null's margins). Pair counts
    are combined before the shuffle; items of a third of all records cost no more than others.
    """
    rows = staged(baskets(records, id, fields))
    n = rows.count()
    least = max(min_records, int(np.ceil(min_share * n - 1e-9)), 1)
    counts = staged(rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_item")))
    hist = [(r[0], r[1]) for r in counts.groupBy("n_item").count().orderBy("n_item").collect()]
    items = sum(c for _, c in hist)
    sizes = [(r[0], r[1]) for r in rows.where(F.size("items") > 0).groupBy(F.size("items").alias("k")).count().orderBy("k").collect()]
    x, y, miss = fitted_null(hist, sizes) if hist else (np.ones(1), np.ones(1), 0.0)
    if miss > MISS:
        raise ValueError(f"the null misses a margin by {miss:.1%}")
    spark = records.sparkSession
    fitness = spark.createDataFrame([(int(f), float(v)) for (f, _), v in zip(hist, x)], "n_item bigint, x double")
    often = counts.where(F.col("n_item") >= least).join(fitness, "n_item")
    # Only frequent items stay in the baskets: the join is on the item, pre-aggregated items are few.
    if least > 1:
        kept = rows.select("id", F.explode("items").alias("item")).join(often.select("item"), "item", "left_semi")
        rows = kept.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = rows.where(F.size("items") > 1).select(F.explode("items").alias("item_a"), "items").select("item_a", F.explode(F.filter("items", lambda b: b > F.col("item_a"))).alias("item_b"))
    pairs = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    for side in "ab":
        pairs = pairs.join(often.select(F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}"), F.col("x").alias(f"x_{side}")), f"item_{side}")
    number = np.array([c for _, c in sizes] or [0], float)

    def surprise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mean, tail = upper_tail(b.n_ab.to_numpy(float), b.x_a.to_numpy(), b.x_b.to_numpy(), y, number) if len(b) else (b.x_a, b.x_b)
            yield b.drop(columns=["x_a", "x_b"]).assign(expected=mean, log10_p=tail)

    found = pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "x_a", "x_b").mapInPandas(surprise, "item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint, expected double, log10_p double")
    found = found.withColumn("n", F.lit(n).cast("bigint")).withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))
    return found.withColumn("tests", F.lit(items * (items - 1) // 2).cast("bigint"))


def discovered(pairs: DataFrame, rate: float = 0.01) -> DataFrame:
    """The pairs with a flag `discovery` under the false-discovery rate, by Benjamini-Hochberg over all pairs of items that there are.

    m is the number of those (`tests`), as a pair never seen together is a hypothesis too, with p = 1. The threshold is the largest p with
    p <= rate * #(p' <= p) / m. It is found by counting again and again from above, which needs no global order.
    """
    pairs = staged(pairs)
    m = pairs.agg(F.max("tests")).first()[0]
    limit, last = float(np.log10(rate)), -1
    while m:
        k = pairs.where(F.col("log10_p") <= limit).count()
        if k == last or k == 0:
            limit = limit if k else -np.inf
            break
        last, limit = k, float(np.log10(rate * k / m))
    return pairs.drop("tests").withColumn("discovery", F.col("log10_p") <= F.lit(limit))
