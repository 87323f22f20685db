"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.session import staged


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for all nodes of the links ``a, b`` (longs): the root is the smallest node of the component.

    Each round joins every node's links with the smallest of them; hubs are aggregated before the shuffle, and a
    hub's links can be split in the join. Every round is written, so a lost executor costs one round at most.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = staged(ordered, "links")
    before = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "least").alias("b")
        ).where("a != b").distinct()
        large = staged(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("least").alias("b")),
        ))).where("a != b").distinct()
        now = staged(small, "links")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
