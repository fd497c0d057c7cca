"""Enumeration of paths through every vertex by self-avoiding joins, and what rotations make of them.

Paths grow by one vertex a round: an equi-join on the last vertex with the
"not yet visited" condition beside it. Rotations turn a path into others with
one end fixed; their classes are components of a path-to-path table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.graphs import Graph


def _settle(df: DataFrame) -> DataFrame:
    """Cut lineage where the session has a checkpoint folder; else keep the rows."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def spanning_paths(graph: Graph, n: int | None = None) -> DataFrame:
    """``path ARRAY<INT>``: each undirected path once, smaller end first.

    The adjacency list joins once a round, so a round adds rows, not width; a graph of n vertices takes n - 1 rounds.
    """
    n = graph.vertices.count() if n is None else n
    if n < 2:
        return graph.vertices.select(F.array("v").alias("path")).limit(0)
    near = graph.adjacency().select(F.col("v").alias("last"), "nbrs").persist()
    near.count()  # with its size known it is broadcast where it is small, and joined by shuffle where not
    paths = graph.vertices.select(F.array("v").alias("path"), F.col("v").alias("last"))
    for k in range(1, n):
        step = paths.join(near, "last").select("path", F.explode(F.filter("nbrs", lambda w: ~F.array_contains("path", w))).alias("w"))
        paths = step.select(F.array_append("path", F.col("w")).alias("path"), F.col("w").alias("last"))
        if k % 6 == 0:
            paths = _settle(paths)
    return paths.where(F.col("path")[0] < F.col("last")).select("path")


PATHS_SQL = """
WITH RECURSIVE edge AS (
  SELECT a.v AS v, b.v AS w FROM {vertices} a JOIN {vertices} b ON a.v <> b.v AND {rule}
), walk(v, path, n) AS (
  SELECT v, {one}, 1 FROM {vertices}
  UNION ALL
  SELECT e.w, {append}, n + 1 FROM walk JOIN edge e ON e.v = walk.v AND NOT {contains}
)
SELECT path FROM walk WHERE n = {n} AND {first} < v
"""


def paths_by_recursion(spark: SparkSession, vertices: str, rule: str, n: int) -> DataFrame:
    """The same by a recursive query over a view of vertices ``v``."""
    return spark.sql(PATHS_SQL.format(vertices=vertices, rule=rule, n=n, one="array(v)", append="array_append(path, e.w)", contains="array_contains(path, e.w)", first="path[0]"))


def canonical(path: Column) -> Column:
    return F.when(path[0] <= F.element_at(path, -1), path).otherwise(F.reverse(path))


def endpoint_type(path: Column) -> Column:
    """Whether the ends' sum is a square, so that the path closes in a square-sum graph."""
    total = path[0] + F.element_at(path, -1)
    return F.when(F.pow(F.floor(F.sqrt(total)), 2) == total, "closable").otherwise("open")


def numbered(paths: DataFrame) -> DataFrame:
    """(path_id, path); an id is the hash of the path, so no ranking is needed and reruns agree."""
    return paths.select(F.xxhash64("path").alias("path_id"), "path")


def rotations(paths: DataFrame, graph: Graph, include_first_pivot: bool = False) -> DataFrame:
    """(path_id, path): all rotations at both ends. At pivot i the last vertex is adjacent to vertex i, and what follows i is reversed."""
    n = F.size("path")
    both = paths.select("path_id", F.explode(F.array("path", F.reverse("path"))).alias("path"))
    pivots = both.select("path_id", "path", F.explode(F.sequence(F.lit(0 if include_first_pivot else 1), n - 3)).alias("i")) if include_first_pivot else both.where(n >= 4).select("path_id", "path", F.explode(F.sequence(F.lit(1), n - 3)).alias("i"))
    ends = pivots.select("path_id", "path", "i", F.col("path")[F.col("i")].alias("v"), F.element_at("path", -1).alias("w"))
    kept = ends.join(graph.arcs(), ["v", "w"], "left_semi")
    turned = F.expr("concat(slice(path, 1, i + 1), reverse(slice(path, i + 2, size(path) - i - 1)))")
    return kept.select("path_id", canonical(turned).alias("path"))


def rotation_graph(paths: DataFrame, graph: Graph, include_first_pivot: bool = False) -> DataFrame:
    """``rot(src, dst)`` without loops; rotations that are no listed path are left out."""
    turned = rotations(paths, graph, include_first_pivot).select(F.col("path_id").alias("src"), "path")
    return turned.join(paths.select(F.col("path_id").alias("dst"), "path"), "path").where("src <> dst").select("src", "dst").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected table (src, dst), root the smallest node: minimum labels with pointer jumping."""
    both = _settle(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = nodes.select("node", F.col("node").alias("root"))
    while True:
        low = both.join(label.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("low"))
        new = label.join(low, "node", "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("to"))
        up = new.select(F.col("node").alias("to"), F.col("to").alias("above"))
        new = _settle(new.join(up, "to").select("node", "root", F.least("to", "above").alias("to")))
        label = new.select("node", F.col("to").alias("root"))
        if new.where("to < root").isEmpty():
            return label


def orbits(paths: DataFrame, graph: Graph, include_first_pivot: bool = False) -> DataFrame:
    """(path_id, root) of the rotation classes."""
    found = components(paths.select(F.col("path_id").alias("node")), rotation_graph(paths, graph, include_first_pivot))
    return found.select(F.col("node").alias("path_id"), "root")


def orbit_sizes(orbit: DataFrame) -> DataFrame:
    """One row: orbits, paths, sorted sizes."""
    sizes = orbit.groupBy("root").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("orbits"), F.sum("size").alias("paths"), F.array_sort(F.collect_list("size")).alias("sizes"))


def _reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, low): the smallest node from which each node is reached along the arcs."""
    label = nodes.select("node", F.col("node").alias("low"))
    while True:
        came = edges.join(label.select(F.col("node").alias("src"), "low"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("low").alias("came"))
        new = _settle(label.join(came, "node", "left").select("node", "low", F.least("low", F.coalesce("came", "low")).alias("to")))
        label = new.select("node", F.col("to").alias("low"))
        if new.where("to < low").isEmpty():
            return label


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc): forward and backward colouring. A node whose colours agree is settled; the rest go on without it."""
    done, left, arcs = None, nodes, _settle(edges)
    while not left.isEmpty():
        forward = _reach(left, arcs)
        # Backward only within a colour: arcs between colours can't be in a component.
        colour = forward.withColumnRenamed("low", "c")
        inside = arcs.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = c").select("node", F.lit(True).alias("hit"))
        while True:
            more = back.join(roots.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(roots, "node", "left_anti")
            more = _settle(more)
            if more.isEmpty():
                break
            roots = _settle(roots.unionAll(more.select("node", F.lit(True))))
        settled = roots.join(colour, "node").select("node", F.col("c").alias("scc"))
        done = settled if done is None else done.unionAll(settled)
        left = _settle(left.join(settled, "node", "left_anti"))
        arcs = _settle(arcs.join(settled.select(F.col("node").alias("src")), "src", "left_anti").join(settled.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return done if done is not None else nodes.select("node", F.col("node").alias("scc"))


def condensation(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, size, in_degree, is_source) of the graph of components."""
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("from")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("scc"))
    between = edges.join(a, "src").join(b, "dst").where("from <> scc").select("from", "scc").distinct()
    sizes = scc.groupBy("scc").agg(F.count("*").alias("size"))
    degree = between.groupBy("scc").agg(F.count("*").alias("in_degree"))
    return sizes.join(degree, "scc", "left").select("scc", "size", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.col("in_degree").isNull().alias("is_source"))
