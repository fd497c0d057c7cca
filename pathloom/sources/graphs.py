"""Graph sources and sinks: generated families, tables, DIMACS text.

A graph is two tables, ``vertices(v INT)`` and ``edges(u INT, w INT)`` with
u < w, each edge once. Generators emit neighbours of each vertex directly, so
building edges is a projection, never a join of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def arcs(self) -> DataFrame:
        """Both directions of each edge as (v, w)."""
        return self.edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), "w"), F.struct(F.col("w").alias("v"), F.col("u").alias("w")))).alias("e")).select("e.v", "e.w")

    def adjacency(self) -> DataFrame:
        """(v, nbrs) with sorted neighbours; isolated vertices have none."""
        near = self.arcs().groupBy("v").agg(F.array_sort(F.collect_set("w")).alias("nbrs"))
        return self.vertices.join(near, "v", "left").select("v", F.coalesce("nbrs", F.array().cast("array<int>")).alias("nbrs"))

    def local(self, most: int = 1_000_000) -> dict[int, list[int]]:
        """Adjacency on the driver, for planning; raises beyond ``most`` edges."""
        rows = self.edges.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} edges; orderings are planned on the driver")
        adj: dict[int, set[int]] = {r["v"]: set() for r in self.vertices.collect()}
        for r in rows:
            adj.setdefault(r["u"], set()).add(r["w"])
            adj.setdefault(r["w"], set()).add(r["u"])
        return {v: sorted(adj[v]) for v in sorted(adj)}

    def relabelled(self, ordering: DataFrame) -> Graph:
        """Vertices renamed to their positions, from 1, in ``ordering(pos, v)``."""
        to = ordering.select("v", (F.col("pos") + 1).cast("int").alias("new"))
        a = self.edges.join(to.withColumnsRenamed({"v": "u", "new": "a"}), "u")
        b = a.join(to.withColumnsRenamed({"v": "w", "new": "b"}), "w")
        return Graph(to.select(F.col("new").alias("v")), b.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w")))


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("v"))


def _from_neighbours(vertices: DataFrame, neighbours: Column) -> Graph:
    """Edges to those of each vertex's ``neighbours`` that are larger."""
    edges = vertices.select(F.col("v").alias("u"), F.explode(neighbours.cast("array<int>")).alias("w")).where("u < w")
    return Graph(vertices, edges)


def square_sum(spark: SparkSession, n: int) -> Graph:
    """u and w are joined where u + w is a square."""
    return square_sum_over(_vertices(spark, n), n)


def square_sum_over(vertices: DataFrame, n: int) -> Graph:
    near = F.expr(f"filter(transform(sequence(1, cast(floor(sqrt({2 * n})) as int)), k -> k * k - v), w -> w > v and w <= {n})")
    return _from_neighbours(vertices, near)


def square_difference(spark: SparkSession, n: int) -> Graph:
    """u and w are joined where w - u is a positive square."""
    near = F.expr(f"filter(transform(sequence(1, cast(floor(sqrt({n})) as int)), k -> v + k * k), w -> w <= {n})")
    return _from_neighbours(_vertices(spark, n), near)


def _board(spark: SparkSession, m: int, n: int, moves: list[tuple[int, int]]) -> Graph:
    """A board of m rows and n columns, numbered by rows from 1."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves])
    r, c = F.floor((F.col("v") - 1) / n), (F.col("v") - 1) % n
    kept = F.filter(steps, lambda s: (r + s["a"]).between(0, m - 1) & (c + s["b"]).between(0, n - 1))
    return _from_neighbours(_vertices(spark, m * n), F.transform(kept, lambda s: (r + s["a"]) * n + c + s["b"] + 1))


def grid(spark: SparkSession, m: int, n: int) -> Graph:
    return _board(spark, m, n, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) == 1])


def king(spark: SparkSession, m: int, n: int) -> Graph:
    return _board(spark, m, n, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])


def knight(spark: SparkSession, m: int, n: int) -> Graph:
    return _board(spark, m, n, [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)])


def hypercube(spark: SparkSession, d: int) -> Graph:
    near = F.expr(f"transform(sequence(0, {max(d, 1) - 1}), k -> ((v - 1) ^ shiftleft(1, k)) + 1)") if d else F.array().cast("array<int>")
    return _from_neighbours(_vertices(spark, 1 << d), near)


def complete(spark: SparkSession, n: int) -> Graph:
    return _from_neighbours(_vertices(spark, n), F.expr(f"sequence(1, {n})"))


FAMILIES = {"square": square_sum, "square_diff": square_difference, "grid": grid, "king": king, "knight": knight, "hamming": hypercube, "complete": complete}


def family(spark: SparkSession, name: str, *sizes: int) -> Graph:
    return FAMILIES[name](spark, *sizes)


def from_edges(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
    """A simple graph from any (u, w) table: loops and repeats are dropped."""
    plain = edges.where("u <> w").select(F.least("u", "w").cast("int").alias("u"), F.greatest("u", "w").cast("int").alias("w")).distinct()
    if vertices is None:
        vertices = plain.select(F.explode(F.array("u", "w")).alias("v")).distinct()
    return Graph(vertices, plain)


def read_dimacs(spark: SparkSession, path: str) -> Graph:
    """DIMACS text. Blank lines and those of ``c`` or ``%`` are skipped.

    With a ``p <format> n m`` line the vertices are 1..n; without it, labels are numbered in order of first
    appearance. ``e u v``, ``a u v`` and bare ``u v`` lines are edges. A file without a vertex is an error.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "raw"))
    words = lines.select("at", F.split(F.trim("raw"), r"\s+").alias("w")).where("w[0] <> '' and not startswith(w[0], 'c') and not startswith(w[0], '%')")
    head = words.where("w[0] = 'p'").orderBy("at").select(F.expr("try_cast(get(w, 2) as int)").alias("n")).first()
    ends = words.where("w[0] in ('e', 'a') and size(w) >= 3").select("at", F.col("w")[1].alias("a"), F.col("w")[2].alias("b"))
    bare = words.where("size(w) = 2 and w[0] not in ('e', 'a', 'p')").select("at", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    ends = ends.unionAll(bare)
    if head and head["n"]:
        return from_edges(ends.selectExpr("cast(a as int) as u", "cast(b as int) as w"), _vertices(spark, head["n"]))
    seen = ends.select(F.explode(F.array(F.struct((F.col("at") * 2).alias("at"), F.col("a").alias("x")), F.struct((F.col("at") * 2 + 1).alias("at"), F.col("b").alias("x")))).alias("s")).groupBy("s.x").agg(F.min("s.at").alias("at"))
    names = seen.select("x", F.row_number().over(Window.orderBy("at")).alias("v"))
    if names.isEmpty():
        raise ValueError(f"{path} has no vertices")
    coded = ends.join(names.select(F.col("x").alias("a"), F.col("v").alias("u")), "a").join(names.select(F.col("x").alias("b"), F.col("v").alias("w")), "b")
    return from_edges(coded, names.select(F.col("v").cast("int").alias("v")))


def dimacs_lines(graph: Graph, form: str = "edge", root: bool = False) -> DataFrame:
    """The lines of a file: ``edge`` is DIMACS, ``gb`` lists bare pairs. ``root`` first joins a new vertex 0 + n to all."""
    edges, n = graph.edges, graph.vertices.agg(F.max("v")).first()[0]
    if root:
        edges = edges.unionByName(graph.vertices.select(F.col("v").alias("u"), F.lit(n + 1).cast("int").alias("w")))
        n += 1
    text = F.concat_ws(" ", "u", "w") if form == "gb" else F.concat_ws(" ", F.lit("e"), "u", "w")
    body = edges.select(F.col("u").alias("i"), F.col("w").alias("j"), text.alias("value"))
    head = edges.agg(F.count("*").alias("m")).select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.concat_ws(" ", F.lit("p edge" if form == "edge" else "* gb"), F.lit(n), "m").alias("value"))
    return head.unionByName(body).orderBy("i", "j").select("value")


def write_dimacs(graph: Graph, path: str, form: str = "edge", root: bool = False) -> None:
    dimacs_lines(graph, form, root).coalesce(1).write.mode("overwrite").text(path)


def degree_stats(graph: Graph) -> DataFrame:
    """One row: vertices, edges, smallest, largest and mean degree, isolated vertices and leaves."""
    degrees = graph.vertices.join(graph.arcs().groupBy("v").agg(F.count("*").alias("d")), "v", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degrees.agg(
        F.count("*").alias("n"), (F.sum("d") / 2).cast("long").alias("edges"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"),
        F.round(F.avg("d"), 6).alias("mean_degree"), F.count_if(F.col("d") == 0).alias("isolated"), F.count_if(F.col("d") == 1).alias("leaves"),
    )
