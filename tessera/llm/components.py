"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. Large: each vertex hangs its larger neighbours on the
    least vertex it knows. Small: it hangs its smaller neighbours and itself there."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    near = both.join(least, F.col("u") == F.col("w"))
    if small:
        moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
    return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _done(edges: DataFrame) -> bool:
    """Whether every vertex is a root or hangs on one root: then the roots are the least ids."""
    ends = edges.select(F.col("u").alias("x"), F.lit(2).alias("r")).union(edges.select("v", F.lit(0)))
    # a root has only zeros; a vertex that hangs once has a single two
    wrong = ends.groupBy("x").agg(F.sum("r").alias("s"), F.max("r").alias("hi"), F.min("r").alias("lo")).where("s > 2 OR (hi = 2 AND lo = 0)")
    return not wrong.agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every vertex of edges (u, v); component is the least id reachable.

    Self-loops, repeated and reversed edges are allowed; null ends are dropped; no edges give no
    rows. Every round is written to the shared folder, so lineage stays short; hubs are joined on,
    never gathered, and the joins are open to skew splitting.
    """
    ends = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = scratch.write(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    k = 0
    while not _done(now):
        k += 1
        now = scratch.write(_stars(_stars(now, small=False), small=True), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
