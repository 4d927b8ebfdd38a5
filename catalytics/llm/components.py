"""Connected components over edge tables (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import landed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on ``(u, v)`` with ``u > v``: hang the neighbours of each node on its smallest one."""
    if large:  # both directions; only larger neighbours move
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    met = edges.join(least, edges["u"] == least["c"])
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _print(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` of every node of ``edges`` (columns a, b): the smallest node it is connected to.

    Every step writes its edges to the shared folder. The tables never pass through the
    driver, and a node with very many neighbours is only aggregated over.
    """
    edges = landed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = _print(edges)
    while before[0]:
        edges = landed(_star(_star(edges, large=True), large=False), name)
        now = _print(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
