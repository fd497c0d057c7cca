import pytest

from pathloom.operators import ordering as O
from pathloom.sources import graphs as G


def pairs(graph):
    return sorted((r.u, r.w) for r in graph.edges.collect())


def test_square_sum(spark):
    want = [(i, j) for i in range(1, 26) for j in range(i + 1, 26) if round((i + j) ** 0.5) ** 2 == i + j]
    assert pairs(G.square_sum(spark, 25)) == want and len(want) == 32


@pytest.mark.parametrize(("name", "sizes", "edges"), [("grid", (3, 4), 17), ("king", (3, 3), 20), ("knight", (3, 4), 14), ("hamming", (3,), 12), ("square_diff", (8,), 11), ("complete", (6,), 15)])
def test_families(spark, name, sizes, edges):
    assert len(pairs(G.family(spark, name, *sizes))) == edges


@pytest.mark.parametrize("text, want", [
    ("c x\np edge 4 4\ne 1 2\n\n%\ne 2 3\ne 3 4\ne 4 1\ne 1 2\n", [(1, 2), (1, 4), (2, 3), (3, 4)]),
    ("e b a\na a d\n", [(1, 2), (2, 3)]),
    ("p tw 3 2\n1 2\n2 3\n", [(1, 2), (2, 3)]),
])
def test_dimacs(spark, tmp_path, text, want):
    (tmp_path / "g").write_text(text)
    assert pairs(G.read_dimacs(spark, str(tmp_path / "g"))) == want


def test_dimacs_empty_and_round_trip(spark, tmp_path):
    (tmp_path / "g").write_text("c nothing\n")
    with pytest.raises(ValueError):
        G.read_dimacs(spark, str(tmp_path / "g"))
    g = G.grid(spark, 2, 3)
    G.write_dimacs(g, str(tmp_path / "out"))
    assert pairs(G.read_dimacs(spark, str(tmp_path / "out"))) == pairs(g)
    rooted = [r.value for r in G.dimacs_lines(g, root=True).collect()]
    assert rooted[0] == "p edge 7 13"


def test_stats_and_relabel(spark):
    g = G.from_edges(spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 3)], "u int, w int"), spark.createDataFrame([(i,) for i in range(1, 5)], "v int"))
    row = G.degree_stats(g).first()
    assert (row.n, row.edges, row.min_degree, row.max_degree, row.isolated, row.leaves) == (4, 2, 0, 2, 1, 2)
    order = spark.createDataFrame([(0, 4), (1, 3), (2, 2), (3, 1)], "pos int, v int")
    assert pairs(g.relabelled(order)) == [(2, 3), (3, 4)]
    assert [r.nbrs for r in g.adjacency().orderBy("v").collect()] == [[2], [1, 3], [2], []]


def test_orderings(spark):
    adj = G.square_sum(spark, 35).local()
    assert O.frontier_stats(adj, O.best_bfs(adj)) == (8, 207)
    assert O.best_bfs_distributed(spark, adj) == O.best_bfs(adj)
    assert O.frontier_stats(adj, O.beam(adj)) == (5, 146)
    for order in (O.min_fill(adj), O.degree_order(adj), O.dfs(adj, 1), *O.diverse(adj).values()):
        assert sorted(order) == list(adj)
    table = O.table(spark, adj, O.beam(adj))
    assert [r.fw for r in O.frontier_table(table).orderBy("pos").collect()] == O.widths(adj, O.beam(adj))
    order, _, cost = O.anneal(adj, O.best_bfs(adj), 300)
    assert sorted(order) == list(adj) and cost <= 10 * 8 + 0.01 * 207
    grid = G.grid(spark, 3, 3).local()
    width, order = O.pathwidth(grid)
    assert width == 3 == O.frontier_stats(grid, order)[0]
    assert O.proxy_cost(grid, order, bound=1) == float("inf") and O.proxy_cost(grid, order) > 0
    assert O.temperature("cosine", 10, 1, 1.0) == 1 and O.bell(99) == O.BELL[-1]
