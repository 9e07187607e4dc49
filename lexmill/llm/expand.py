"""From pairs of classes to pairs of their members, however large a class is.

The members of a class are dealt into blocks of about BLOCK by the hash of their id; a pair of classes becomes pairs of blocks, so no join key has
more than a block's rows and no task holds a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

BLOCK = 1024


def _blocks(members: DataFrame, links: DataFrame | None, cls: str, within: bool, block: int) -> tuple[DataFrame, DataFrame]:
    """(members with their block, (cls, blocks)), both staged, of the classes that have a pair: linked ones and, if `within`, those of several members."""
    sizes = members.groupBy(cls).agg(F.count("*").alias("n"))
    several = F.col("n") > 1 if within else F.lit(False)
    if links is not None:
        ends = links.select(F.explode(F.array("a", "b")).alias(cls)).distinct().withColumn("linked", F.lit(True))
        sizes = sizes.join(ends, cls, "left").where(several | F.col("linked"))
    else:
        sizes = sizes.where(several)
    sizes = staged(sizes.select(cls, F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    dealt = members.join(sizes, cls).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return staged(dealt.select("id", cls, "block")), sizes


def member_pairs(members: DataFrame, links: DataFrame | None, cls: str = "cls", within: bool = True, block: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of members of linked classes, and of one class if `within`. members: (id, cls), ids unique. links: (a, b),
    each pair of different classes once."""
    dealt, sizes = _blocks(members, links, cls, within, block or BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.select(F.col("id").alias("x"), F.col(cls).alias("a"), F.col("block").alias("i"))
    right = dealt.select(F.col("id").alias("y"), F.col(cls).alias("b"), F.col("block").alias("j"))
    found = []
    if links is not None:
        size = lambda name: sizes.select(F.col(cls).alias(name), F.col("blocks").alias(f"n_{name}"))
        grid = links.select("a", "b").join(size("a"), "a").join(size("b"), "b").withColumn("i", numbers("n_a")).withColumn("j", numbers("n_b"))
        found.append(grid.select("a", "b", "i", "j").join(left, ["a", "i"]).join(right, ["b", "j"]).select("x", "y"))
    if within:
        grid = sizes.select(F.col(cls).alias("a"), F.col("blocks").alias("n_a")).withColumn("i", numbers("n_a")).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("n_a") - 1)))
        own = grid.select("a", "i", "j").join(left, ["a", "i"]).join(right.withColumnRenamed("b", "a"), ["a", "j"])
        found.append(own.where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("x", "y"))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
