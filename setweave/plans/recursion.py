"""Recursive plans: semi-naive loops over DataFrames, with lineage cut by tables in the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.plans.storage import cut, drop

#: Rounds whose results explore() reads one by one before they are written as one table, so that plans stay small.
TABLES = 32


def explore(source: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node``s reachable from those of ``source`` over ``edges`` (``src``, ``dst``), source included.

    Each round joins the frontier only and drops what was visited before, until none is new. If that takes more than
    ``rounds`` (None: no limit), it is an error.
    """
    seen = front = cut(source.select("node").distinct())
    parts = [seen]
    for n in count():
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            drop(front)
            return seen
        if rounds is not None and n >= rounds:
            raise ValueError(f"more nodes after {rounds} rounds")
        parts.append(front)
        seen = seen.unionByName(front)
        if n % TABLES == TABLES - 1:
            seen = cut(seen)
            drop(*parts[:-1])
            parts = [seen, front]


def closure(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Transitive closure of ``src``, ``dst``: new pairs are composed with all known ones until none is new, so paths double in
    length with each round. More than ``rounds`` (None: no limit) are an error."""
    known = new = cut(edges.select("src", "dst").distinct())
    for n in count():
        if rounds is not None and n > rounds:
            raise ValueError(f"more pairs after {rounds} rounds")
        far = known.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        made = new.join(far, "dst").select("src", F.col("end").alias("dst")).distinct()
        new = cut(made.join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            drop(new)
            break
        known = known.unionByName(new)
    return known


def topsort(edges: DataFrame) -> DataFrame:
    """``node`` and ``level`` (0: nothing before it); an error for a cycle. Level by level, with anti joins."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    rest, left, out, level = cut(edges.select("src", "dst")), cut(nodes), None, 0
    while not left.isEmpty():
        free = cut(left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            raise ValueError("cycle")
        own = free.withColumn("level", F.lit(level))
        out = own if out is None else out.unionByName(own)
        before = left, rest
        left = cut(left.join(free, "node", "left_anti"))
        rest = cut(rest.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
        drop(*before)
        level += 1
    drop(left, rest)
    return out if out is not None else nodes.withColumn("level", F.lit(0))
