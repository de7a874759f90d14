"""Connected components of a table of links, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the same within a component.

    Each round every node hooks to its smallest neighbour, chains are halved twice, and the links are rewritten between
    the hooks. Links inside a component vanish, so the table shrinks each round. All tables stay distributed; every
    round's result is written to the shared folder. Both sides of each join are plain tables, so that a node with very
    many links is split by adaptive skew handling.
    """
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "cc-links")
    total: DataFrame | None = None
    for _ in range(rounds):
        if not edges.head(1):
            break
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "cc-hook")
        for _ in range(2):
            far = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            nearer = materialize(hook.join(far, "p").select("u", F.col("q").alias("p")), "cc-hook")
            discard(hook)
            hook = nearer
        if total is None:
            total = hook
        else:
            step = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            merged = materialize(total.join(step, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "cc-total")
            total = merged
        left = edges.join(hook.select("u", F.col("p").alias("pu")), "u")
        both_ends = left.join(hook.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        smaller = materialize(both_ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-links")
        discard(edges)
        edges = smaller
    else:
        raise RuntimeError("components did not settle")
    if total is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return total.select(F.col("u").alias("node"), F.col("p").alias("root"))
