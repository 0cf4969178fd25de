"""Connected components of a graph given as an edge table, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.session import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b"), F.col("a")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node``, ``root``: each node that has an edge, and its component's smallest node.

    Rounds of large star and small star. A large-star round links every node's
    larger neighbours to its least neighbour, a small-star round its smaller ones;
    the number of edges never grows, and the rounds stop when every component is
    a star. A node with very many edges is only ever counted with a partial
    aggregate and joined back, never gathered. Each round's edges are written to
    the shared folder, so a lost executor costs no earlier round. Null ends and
    loops are ignored; repeated edges are one edge; an empty table gives none.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    before = _signature(now)
    while before[0]:
        both = _both(now)
        least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        least = least.select("c", F.least("c", "m").alias("m"))
        large = (
            now.select(F.col("b").alias("c"), F.col("a").alias("x"))
            .join(least, "c")
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = stage(large)
        low = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        small = (
            large.select(F.col("a").alias("c"), F.col("b").alias("x"))
            .join(low, "c")
            .select(F.explode(F.array(F.struct(F.col("x").alias("a")), F.struct(F.col("c").alias("a")))).alias("e"), "m")
            .select("e.a", F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = stage(small)
        after = _signature(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select("root", "root").distinct())
