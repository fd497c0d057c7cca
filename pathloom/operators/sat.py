"""Cycles through every vertex as propositional clauses, generated as rows, and their DIMACS form."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..sources.graphs import Graph


def encode(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(clauses(lits), vars(id, kind, a, b)): an arc variable for each direction of an edge, a position for each vertex.

    Every vertex has exactly one arc out and one in; exactly one position, and no two the same; vertex 1 is at position
    1; an arc into any vertex but vertex 1 leads one position on.
    """
    n = graph.vertices.count()
    # Ids in closed form: arcs by (a, b) up to n * n, positions after them, so no ranking is needed.
    arc = lambda a, b: (a - 1) * n + b
    place = lambda v, t: n * n + (v - 1) * n + t
    arcs = graph.arcs().select(F.col("v").alias("a"), F.col("w").alias("b"))
    variables = arcs.select(arc(F.col("a"), F.col("b")).alias("id"), F.lit("arc").alias("kind"), "a", "b")
    spots = graph.vertices.select(F.col("v").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("b"))
    variables = variables.unionByName(spots.select(place(F.col("a"), F.col("b")).alias("id"), F.lit("position").alias("kind"), "a", "b"))

    def exactly_one(groups: DataFrame) -> DataFrame:
        """From (lits): one clause for any, and one for each two."""
        two = F.expr("flatten(transform(lits, (x, i) -> transform(slice(lits, i + 2, size(lits)), y -> array(-x, -y))))")
        return groups.select("lits").unionAll(groups.select(F.explode(two).alias("lits")))

    out = arcs.groupBy("a").agg(F.array_sort(F.collect_list(arc(F.col("a"), F.col("b")))).alias("lits"))
    into = arcs.groupBy("b").agg(F.array_sort(F.collect_list(arc(F.col("a"), F.col("b")))).alias("lits"))
    at = graph.vertices.select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda t: place(F.col("v"), t)).alias("lits"))
    spots_of = graph.vertices.agg(F.array_sort(F.collect_list("v")).alias("vs")).select("vs", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("t"))
    held = spots_of.select(F.transform("vs", lambda v: place(v, F.col("t"))).alias("lits"))
    steps = arcs.where("b <> 1").select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("t"))
    follow = steps.where(F.col("t") < n).select(F.array(-arc(F.col("a"), F.col("b")), -place(F.col("a"), F.col("t")), place(F.col("b"), F.col("t") + 1)).alias("lits"))
    last = steps.where(F.col("t") == n).select(F.array(-arc(F.col("a"), F.col("b")), -place(F.col("a"), F.col("t"))).alias("lits"))
    first = graph.vertices.where("v = 1").select(F.array(place(F.col("v"), F.lit(1))).alias("lits"))
    clauses = exactly_one(out).unionAll(exactly_one(into)).unionAll(exactly_one(at)).unionAll(exactly_one(held)).unionAll(follow).unionAll(last).unionAll(first)
    return clauses.select(F.col("lits").cast("array<int>").alias("lits")), variables


def cnf_lines(clauses: DataFrame, variables: DataFrame, show: str = "arc") -> DataFrame:
    """DIMACS lines (i, value); models are to be counted over the variables of kind ``show``."""
    top = variables.agg(F.max("id").alias("n")).crossJoin(clauses.agg(F.count("*").alias("m")))  # one row each
    head = top.select(F.lit(0).alias("i"), F.explode(F.array(F.lit("c t pmc"), F.concat_ws(" ", F.lit("p cnf"), "n", "m"))).alias("value"))
    shown = variables.where(F.col("kind") == show).agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.lit(1).alias("i"), F.concat(F.lit("c p show "), F.concat_ws(" ", F.col("ids").cast("array<string>")), F.lit(" 0")).alias("value"))
    body = clauses.select(F.lit(2).alias("i"), F.concat(F.concat_ws(" ", F.col("lits").cast("array<string>")), F.lit(" 0")).alias("value"))
    return head.unionAll(shown).unionAll(body)


def count_models(clauses: list[list[int]], show: list[int], most: int = 20) -> int:
    """Distinct assignments of ``show`` that extend to a model, by trial and unit propagation; for tiny formulas."""
    if len(show) > most:
        raise ValueError(f"at most {most} shown variables")

    def solve(true: set[int]) -> bool:
        true = set(true)
        while True:
            unit = None
            for c in clauses:
                if any(x in true for x in c):
                    continue
                rest = [x for x in c if -x not in true]
                if not rest:
                    return False
                if len(rest) == 1:
                    unit = rest[0]
                    break
            if unit is None:
                break
            true.add(unit)
        free = next((x for c in clauses if not any(y in true for y in c) for x in c if -x not in true), None)
        return free is None or solve(true | {free}) or solve(true | {-free})

    return sum(solve({v if b else -v for v, b in zip(show, bits, strict=True)}) for bits in product((False, True), repeat=len(show)))
