"""Depth-first walks of graphs of any size.

Small graphs go side by side, many to a task. A large tree is walked by all tasks: its links,
taken both ways, form one round trip (every arrival leaves for the next neighbour around the
node), ranked by doubling pointers; what lies between leaving for a node and coming back is
its subtree, and a node's place is its parent's place plus one plus the subtrees before it,
summed along the parents by doubling again. Only a large graph that has cycles in the walked
part is one task's work: the order of a depth-first walk there cannot be told from its parts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import positions
from ..plans.session import cut, small, stored
from .sequences import both_ways, per_group

#: Nodes of a graph that shares its task with others; pointers followed between two writes.
TASK_NODES, HOPS = 10_000, 2


def summed_ahead(links: DataFrame, key: str, ahead: str, value: str) -> DataFrame:
    """(key, sum, end): values from a row along its pointers up to the last row, whose pointer is NULL.

    Rows on a circle never end and are left out. Each hop doubles the distance a pointer spans,
    so a chain of n rows takes log2(n) joins; a row whose pointer has ended meets no join again.
    """
    rows = stored(links.select(F.col(key).alias("k"), F.col(ahead).alias("to"), F.col(key).alias("end"), F.col(value).cast("long").alias("sum")))
    most, live, spanned = rows.count(), rows.filter("to IS NOT NULL").count(), 1
    while live and spanned < most:
        for _ in range(HOPS):
            there = rows.select(F.col("k").alias("to"), F.col("to").alias("_to"), F.col("end").alias("_end"), F.col("sum").alias("_sum"))
            went = rows.filter("to IS NOT NULL").join(there, "to").select("k", F.col("_to").alias("to"), F.col("_end").alias("end"), (F.col("sum") + F.col("_sum")).alias("sum"))
            rows = rows.filter("to IS NULL").select("k", "to", "end", "sum").unionByName(went)
            spanned *= 2
        rows = stored(rows)
        live = rows.filter("to IS NOT NULL").count()
    return rows.filter("to IS NULL").select(F.col("k").alias(key), "sum", "end")


def roots(nodes: DataFrame, edges: DataFrame, graph: str, node: str) -> DataFrame:
    """(graph, root): the first free end, else the first node."""
    degrees = both_ways(edges, graph).groupBy(graph, F.col("node").alias(node)).agg(F.count("*").alias("_degree"))
    held = nodes.join(degrees, [graph, node], "left")
    rank: Column = F.struct(F.when(F.col("_degree") == 1, 0).otherwise(1), "ord")
    return held.groupBy(graph).agg(F.min_by(node, rank).alias("root"))


def _tree_places(nodes: DataFrame, edges: DataFrame, graph: str, node: str, graphs: int) -> tuple[DataFrame, DataFrame]:
    """Places in the graphs whose walked part is a tree, and (graph) of these. What there is once for each of the few ``graphs``
    travels to the tasks: joined by the graph, all rows of one would be one task's."""
    root = small(cut(roots(nodes, edges, graph, node)), graphs)
    ords = nodes.select(graph, F.col(node).alias("v"), F.col("ord").alias("v_ord"))
    arcs = both_ways(edges, graph).withColumnsRenamed({"node": "u", "other": "v"}).join(ords, [graph, "v"])
    # Arcs out of a node in the order of their ends; an arc is known by its number from here on.
    around = positions(arcs, [graph, "u"], ["v_ord", "v"], "_nth").rows
    around = stored(around.withColumn("arc", F.monotonically_increasing_id()))
    counts = around.groupBy(graph, "u").agg(F.count("*").alias("_degree"))
    back = around.select(graph, F.col("u").alias("v"), F.col("v").alias("u"), F.col("_nth").alias("_back"), F.col("arc").alias("twin"))
    turned = around.join(back, [graph, "u", "v"]).join(counts.withColumnRenamed("u", "v"), [graph, "v"])
    turned = turned.withColumn("_turn", F.pmod(F.col("_back") + 1, F.col("_degree")))
    leaving = around.select(graph, F.col("u").alias("v"), F.col("_nth").alias("_turn"), F.col("arc").alias("next"))
    # The round trip starts with the root's first arc; the arc that would lead to it again is the last.
    trip = turned.join(leaving, [graph, "v", "_turn"]).join(root, graph)
    trip = trip.withColumn("next", F.when(~((F.col("v") == F.col("root")) & (F.col("_turn") == 0)), F.col("next")))
    trip = stored(trip.select(graph, "u", "v", "v_ord", "arc", "twin", "next", "root", F.lit(1).alias("one")))
    ranked = stored(trip.join(summed_ahead(trip, "arc", "next", "one"), "arc").select(graph, "u", "v", "v_ord", "arc", "twin", "root", "sum"))
    # A tree's trip takes every link both ways and has one link less than nodes.
    twins = ranked.select(F.col("arc").alias("twin"), F.col("sum").alias("_twin_sum"))
    paired = stored(ranked.join(twins, "twin", "left"))
    told = paired.groupBy(graph).agg(F.count("*").alias("_arcs"), F.count("_twin_sum").alias("_paired"))
    met = paired.select(graph, "v").distinct().groupBy(graph).agg(F.count("*").alias("_nodes"))
    told = small(cut(told), graphs)
    lone = root.join(told, graph, "left_anti").select(graph)
    trees = cut(small(met, graphs).join(told, graph).filter("_arcs = _paired AND _arcs = 2 * (_nodes - 1)").select(graph).unionByName(lone))
    trees = small(trees, graphs)
    # ``sum`` falls along the trip: a link is taken downwards where its other way comes later.
    down = paired.filter(F.col("sum") > F.col("_twin_sum")).join(trees, graph, "left_semi")
    down = down.select(graph, "u", "v", "v_ord", "arc", "root", ((F.col("sum") - F.col("_twin_sum") + 1) / 2).cast("long").alias("size"))
    beside = positions(down, [graph, "u"], ["v_ord", "v"], "_nth").running_sum("size", "_upto").rows
    # Parents point upwards: a step is one plus the subtrees of the older ones beside it.
    step = beside.withColumn("step", F.col("_upto") - F.col("size") + 1)
    parents = down.select(graph, F.col("v").alias("u"), F.col("arc").alias("up"))
    climbed = stored(step.join(parents, [graph, "u"], "left").select(graph, "v", "arc", "up", "step"))
    places = climbed.join(summed_ahead(climbed, "arc", "up", "step"), "arc").select(graph, F.col("v").alias(node), F.col("sum").alias("place"))
    first = root.join(trees, graph, "left_semi").select(graph, F.col("root").alias(node), F.lit(0).cast("long").alias("place"))
    return first.unionByName(places), trees


def _in_tasks(nodes: DataFrame, edges: DataFrame, graph: str, node: str) -> DataFrame:
    listed = nodes.select(graph, node, "ord").join(both_ways(edges, graph).withColumnRenamed("node", node), [graph, node], "left")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.drop_duplicates(node).sort_values("ord")[node].tolist()
        at = {n: i for i, n in enumerate(order)}
        near = {n: sorted({o for o in g["other"].dropna() if o in at}, key=at.get) for n, g in frame.groupby(node)}
        ends = [n for n in order if len(near[n]) == 1]
        stack, seen = [(ends or order)[0]], {}
        while stack:
            here = stack.pop()
            if here not in seen:
                seen[here] = len(seen)
                stack.extend(o for o in reversed(near[here]) if o not in seen)
        return pd.DataFrame({graph: frame[graph].iloc[0], node: list(seen), "place": list(seen.values())})

    kind = dict(nodes.dtypes)
    return per_group(listed, graph, work, f"{graph} {kind[graph]}, {node} {kind[node]}, place long")


def walks(nodes: DataFrame, edges: DataFrame, graph: str = "graph", node: str = "node", task_nodes: int = TASK_NODES) -> DataFrame:
    """Depth first from the first free end (else the first node), oldest neighbour first: (graph, node, place).

    ``nodes`` (graph, node, ord; ``ord`` tells the nodes of a graph apart) and ``edges`` as ``clean_edges`` leaves them.
    """
    large = cut(nodes.groupBy(graph).agg(F.count("*").alias("_n")).filter(F.col("_n") > task_nodes).select(graph))
    found = large.count()
    if not found:
        return _in_tasks(nodes, edges, graph, node)
    large = small(large, found)
    part = lambda df, of, how: df.join(of, graph, how)
    places, trees = _tree_places(part(nodes, large, "left_semi"), part(edges, large, "left_semi"), graph, node, found)
    rest = large.join(trees, graph, "left_anti").unionByName(nodes.select(graph).distinct().join(large, graph, "left_anti"))
    return places.unionByName(_in_tasks(part(nodes, rest, "left_semi"), part(edges, rest, "left_semi"), graph, node))
