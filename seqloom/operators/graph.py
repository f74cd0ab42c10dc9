"""Graphs as edge relations: simple undirected sets and connected components.

Components come from alternating star contractions: each round points neighbours at the least node of a
neighbourhood, first those larger than the centre, then those smaller. Rounds are written to the shared
folder, so lineage stays short and a lost executor costs one round. A hub's edges are only grouped by
`min` (partial aggregation), whose result is written as well: the join of the edges to it then has a plain
table on either side, so adaptive execution can split a hub's rows over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import Scratch


def simple_edges(edges: DataFrame) -> DataFrame:
    """src < dst, distinct; loops and nulls dropped."""
    a, b = edges.columns[:2]
    return edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where(f"`{a}` <> `{b}`").distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return simple_edges(edges.union(more))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return simple_edges(edges).join(simple_edges(gone), ["src", "dst"], "left_anti")


def has_edge(edges: DataFrame, a: int, b: int) -> bool:
    return bool(simple_edges(edges).where((F.col("src") == min(a, b)) & (F.col("dst") == max(a, b))).head(1))


def degrees(edges: DataFrame) -> DataFrame:
    e = simple_edges(edges)
    return e.select(F.explode(F.array("src", "dst")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _written(edges: DataFrame, scratch: Scratch, rows: int | None) -> tuple[DataFrame, str, tuple]:
    """Writes edges; their number and a sum of their hashes come with the writing, without a pass of their own."""
    seen = Observation()
    table, path = scratch.write(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), rows)
    return table, path, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """edges: two columns of one orderable type. Rows of node and component (the least node it reaches).

    Nulls and loops join nothing; nodes without an edge have no row. rows: the number of edges, where it is known.
    """
    a, b = edges.columns
    now, path, state = _written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` <> `{b}`").distinct(), scratch, rows)
    before = None
    while state != before and state[0]:
        before, old, rows = state, [path], 2 * state[0]  # a round doesn't add edges; both directions are listed
        both = now.union(now.select("b", "a"))
        low, at = scratch.write(_least(both).select("a", F.least("a", "m").alias("m")), rows)
        old.append(at)
        wide, at = scratch.write(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), rows)
        old.append(at)
        # Every edge of `wide` leads from a node to a lesser one.
        low, at = scratch.write(_least(wide), rows)
        old.append(at)
        down = wide.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now, path, state = _written(down.union(low.select("a", F.col("m").alias("b"))).distinct(), scratch, rows)
        for p in old:
            scratch.drop(p)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex and component for all vertices (first column); single ones are their own component."""
    v = vertices.columns[0]
    found = connected_components(edges.select(*edges.columns[:2]), Scratch(edges.sparkSession))
    return vertices.select(F.col(v).alias("vertex")).distinct().join(found, F.col("vertex") == F.col("node"), "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
