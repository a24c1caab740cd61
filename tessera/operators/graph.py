"""Graphs as edge tables (src, dst): degrees, reachability, paths, components, ranks, transforms.

Iterative algorithms run as joins whose state is written to the shared folder
in each round, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import bucketed, cut, release

#: Edges that a task links at once.
HELD = 1 << 20


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(reverse(edges)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree in one aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def density(edges: DataFrame, directed: bool = True) -> DataFrame:
    n = nodes(edges).count()
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    return m.select((F.col("m") * (1.0 if directed else 2.0) / F.lit(float(max(1, n * (n - 1))))).alias("density"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst").select(F.col("src").alias("node")).distinct()


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges between the nodes of ``keep`` (node)."""
    return edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def contract(edges: DataFrame, merged: DataFrame, name: str) -> DataFrame:
    """The nodes of ``merged`` become one; loops and repeats go."""
    m = merged.select(F.col("node").alias("m"))
    out = edges.join(m, edges["src"] == m["m"], "left").select(F.when(F.col("m").isNotNull(), F.lit(name)).otherwise(F.col("src")).alias("src"), "dst")
    out = out.join(m, out["dst"] == m["m"], "left").select("src", F.when(F.col("m").isNotNull(), F.lit(name)).otherwise(F.col("dst")).alias("dst"))
    return out.filter("src != dst").distinct()


def line_graph(edges: DataFrame) -> DataFrame:
    """Edges that follow one another."""
    nxt = edges.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    return edges.join(nxt, "dst").select("src", F.col("dst").alias("via"), F.col("end").alias("dst"))


def moralize(edges: DataFrame) -> DataFrame:
    """Undirected edges (a < b) with the parents of each node married."""
    other = edges.select("dst", F.col("src").alias("src2"))
    wed = edges.join(other, "dst").filter("src < src2").select(F.col("src").alias("a"), F.col("src2").alias("b"))
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").union(wed).distinct()


def distances(edges: DataFrame, source) -> DataFrame:
    """(node, distance) of all nodes that a source reaches, level by level."""
    seen = cut(edges.sparkSession.createDataFrame([(source, 0)], f"node {dict(edges.dtypes)['src']}, distance int"), "bfs")
    had, level = 1, 0
    while True:
        front = seen.filter(F.col("distance") == level).select(F.col("node").alias("src"))
        step = edges.join(front, "src").select(F.col("dst").alias("node"), F.lit(level + 1).alias("distance"))
        seen = cut(seen.union(step).groupBy("node").agg(F.min("distance").alias("distance")), "bfs")
        has = seen.count()
        if has == had:
            return seen
        had, level = has, level + 1


def descendants(edges: DataFrame, node) -> DataFrame:
    return distances(edges, node).filter("distance > 0").select("node")


def ancestors(edges: DataFrame, node) -> DataFrame:
    return descendants(reverse(edges), node)


def has_path(edges: DataFrame, source, target) -> bool:
    return distances(edges, source).filter(F.col("node") == F.lit(target)).count() > 0


def shortest_path(edges: DataFrame, source, target) -> list:
    """Nodes of one shortest path, smallest predecessors first; empty if there is none."""
    d = cut(distances(edges, source), "bfs-all")
    end = d.filter(F.col("node") == F.lit(target)).first()
    if end is None:
        return []
    path = [target]
    for k in range(end.distance - 1, -1, -1):
        before = edges.filter(F.col("dst") == F.lit(path[0])).join(d.filter(F.col("distance") == k), edges["src"] == d["node"])
        path.insert(0, before.agg(F.min("src")).first()[0])
    return path


def _linked(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> pa.RecordBatch:
    """(src, dst): each node of some edges with the smallest one that is linked to it."""
    ends = pa.chunked_array([*src.chunks, *dst.chunks], src.type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    label = np.arange(len(order))
    place = np.empty_like(label)
    place[order.to_numpy()] = label
    a, b = np.split(place[ends.indices.to_numpy()], 2)
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    found = ends.dictionary.take(order)
    return pa.RecordBatch.from_arrays([found, found.take(pa.array(label))], ["src", "dst"])


def _forest(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Fewer edges that link the same nodes: what one task holds becomes stars (node, centre), with a loop at each centre.

    A task reduces ``HELD`` edges at a time; with ``whole``, which is for a counted size, all that it has.
    """
    names = ["src", "dst"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD and not whole:
                held = [_linked(*pa.Table.from_batches(held).columns)]
                n = len(held[0])
                if n > HELD // 2:
                    yield held[0]
                    held, n = [], 0
        if n:
            yield _linked(*pa.Table.from_batches(held).columns)

    return edges.select(*names).mapInArrow(run, edges.select(*names).schema)


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is linked to it.

    Tasks replace their edges by stars. While more than ``HELD`` edges are left,
    each node takes its smallest neighbour, pointers are followed to their ends, and the
    edges between different ends are the next, smaller graph; then one task links the
    rest. The ends are carried back through the rounds. Edges with a null end link nothing.
    """
    spark, kind = edges.sparkSession, nodes(edges).schema["node"].dataType
    given = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    left, rounds = cut(_forest(given), "wcc-edges"), []
    while left.count() > HELD:
        near = left.union(reverse(left)).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("l"))
        label, moved = cut(near.select("node", F.least("node", "l").alias("l")), "wcc"), True
        while moved:
            up = label.select(F.col("node").alias("l"), F.col("l").alias("u"))
            new = cut(label.join(up, "l").select("node", F.col("u").alias("l"), (F.col("u") != F.col("l")).alias("moved")), "wcc")
            moved = not new.filter("moved").isEmpty()
            release(spark, label)
            label = new
        rounds.append(label)
        open_ = left.join(label.select(F.col("node").alias("src"), F.col("l").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("l").alias("b")), "dst")
        new = cut(_forest(open_.filter("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "wcc-edges")
        release(spark, left)
        left = new
    found = cut(_forest(left.repartition(1), whole=True).toDF("node", "component"), "wcc")
    for label in reversed(rounds):
        ends = found.toDF("l", "component")
        new = cut(label.join(ends, "l", "left").select("node", F.coalesce("component", "l").alias("component")), "wcc")
        release(spark, found, label)
        found = new
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of those that reach it and that it reaches.

    Colours (the smallest node that reaches each) are spread forwards; those that
    a colour's own node meets backwards within the colour are one component. Nodes
    found are taken out, until none is left.
    """
    left, done = cut(edges.select("src", "dst").filter("src != dst").distinct(), "scc-edges"), None
    alone = nodes(edges).withColumn("component", F.col("node"))
    while not left.isEmpty():
        colour = cut(nodes(left).withColumn("c", F.col("node")), "scc")
        while True:  # forwards
            came = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut(colour.join(came, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "scc")
            colour = new.select("node", "c")
            if new.filter("moved").isEmpty():
                break
        inside = left.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").filter("c = d").select("src", "dst", "c")
        inside = cut(inside, "scc-inside")
        own = cut(colour.filter("node = c"), "scc-own")
        had = own.count()
        while True:  # backwards
            back = inside.join(own.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "c")
            own = cut(own.union(back).distinct(), "scc-own")
            has = own.count()
            if has == had:
                break
            had = has
        found = own.select("node", F.col("c").alias("component"))
        done = cut(found if done is None else done.union(found), "scc-done")
        gone = found.select("node")
        left = cut(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"), "scc-edges")
    if done is None:
        return alone
    return alone.drop("component").join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path that ends at the node; raises for a cycle."""
    level = cut(nodes(edges).withColumn("level", F.lit(0)), "topo")
    for _ in range(level.count() + 1):
        up = edges.join(level, edges["src"] == level["node"]).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("n"))
        new = cut(level.join(up, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("level"), (F.coalesce("n", F.lit(0)) != F.col("level")).alias("moved")), "topo")
        if new.filter("moved").isEmpty():
            return new.select("node", "level")
        level = new.select("node", "level")
    raise ValueError("the graph has a cycle")


def is_dag(edges: DataFrame) -> bool:
    """Whether taking nodes without predecessors away, round by round, takes all."""
    left = cut(edges.select("src", "dst").distinct(), "dag")
    had = left.count()
    while had:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "dag")
        has = left.count()
        if has == had:
            return False
        had = has
    return True


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, epsilon: float = 1e-6, once: bool = False) -> DataFrame:
    """(node, rank) by power iteration; the mass of nodes without successors is spread over all.

    Edges are dealt by their source once, and repeats go there with ``once``; rounds
    move ranks and what arrives at nodes, not edges.
    """
    spark = edges.sparkSession
    links = bucketed(edges.select("src", "dst"), "pagerank-edges", "src", once)
    ends = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k")).union(links.select("dst", F.lit(None).cast("long")).distinct())
    rank = cut(ends.groupBy("node").agg(F.max("k").alias("k")), "pagerank")
    sink = F.col("k").isNull() & F.col("node").isNotNull()
    n, lost = rank.agg(F.count(F.lit(1)), F.count_if(sink)).first()
    first, rank, lost = rank, rank.withColumn("rank", F.lit(1.0 / max(n, 1))), lost / max(n, 1)
    for _ in range(rounds if n else 0):
        given = rank.filter("k IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") * (1.0 / F.col("k"))).alias("c"))
        got = links.join(given.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("c").alias("g"))
        base = (1 - damping) / n + damping * lost / n
        new = rank.join(got, "node", "left").select("node", "k", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("g", F.lit(0.0))).alias("rank"))
        new = cut(new, "pagerank")
        far, lost = new.agg(F.max(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(sink, F.col("rank"))), F.lit(0.0))).first()
        release(spark, first)
        first = rank = new
        if far < epsilon:
            break
    release(spark, links)
    return rank.select("node", "rank")
