import itertools
import random

import pytest

from pathloom.operators import frontier as D, ordering as O
from pathloom.sources import graphs as G, profiles as P


def brute(adj):
    paths = cycles = 0
    for p in itertools.permutations(adj):
        if all(b in adj[a] for a, b in zip(p, p[1:], strict=False)):
            paths += 1
            cycles += p[0] in adj[p[-1]]
    n = len(adj)
    return paths // 2, cycles // (2 * n) if n > 2 else 0


@pytest.mark.parametrize(("n", "paths", "cycles"), [(1, 0, 0), (2, 0, 0), (15, 1, 0), (20, 0, 0), (23, 3, 0), (25, 10, 0), (30, 20, 0), (32, 392, 1), (34, 4041, 11), (35, 17175, 57), (40, 39550, 64)])
def test_square_sum(spark, n, paths, cycles):
    got = D.count(spark, G.square_sum(spark, n).local())
    assert (got.paths, got.cycles) == (paths, cycles)


@pytest.mark.parametrize(("name", "sizes", "want"), [("grid", (4, 4), (276, 6)), ("king", (2, 3), (48, 4)), ("knight", (3, 4), (8, 0)), ("hamming", (4,), (45696, 1344)), ("square_diff", (12,), (1313, 32)), ("complete", (10,), (1814400, 181440))])
def test_families(spark, name, sizes, want):
    got = D.count(spark, G.family(spark, name, *sizes).local())
    assert (got.paths, got.cycles) == want


def test_random_graphs_any_order_any_pruning(spark):
    rng = random.Random(3)
    for _ in range(25):
        n = rng.randrange(2, 8)
        adj = {v: [] for v in range(1, n + 1)}
        for a, b in itertools.combinations(adj, 2):
            if rng.random() < 0.6:
                adj[a].append(b)
                adj[b].append(a)
        adj = {v: sorted(ws) for v, ws in adj.items()}
        order = list(adj)
        rng.shuffle(order)
        for prune in (True, False):
            got = D.count(spark, adj, order, "local", prune=prune)
            assert (got.paths, got.cycles) == brute(adj), (adj, order)


@pytest.mark.parametrize("form", ["packed", "native"])
def test_distributed_forms(spark, form):
    for g in (G.grid(spark, 2, 3), G.complete(spark, 5)):
        adj = g.local()
        got = D.count(spark, adj, form=form)
        assert (got.paths, got.cycles) == brute(adj)


def test_switches_to_spark_and_restarts(spark, tmp_path):
    adj = G.square_sum(spark, 25).local()
    assert D.count(spark, adj, local_rows=8).paths == 10
    path = str(tmp_path / "run")
    D.count(spark, adj, form="packed", checkpoint=path, every=4, step_limit=13)
    again = D.count(spark, adj, form="packed", checkpoint=path, every=4)
    assert again.paths == 10 and len(again.steps) == 25
    assert D.Checkpoints(path, D.fingerprint(adj, sorted(adj))).load(spark) is None  # another order


def test_isolated_vertex_and_wide_states(spark):
    adj = G.grid(spark, 2, 3).local() | {7: []}
    assert D.count(spark, adj).paths == 0
    star = {0: list(range(1, 19))} | {i: [0] for i in range(1, 19)}
    order = [*range(1, 19), 0]
    assert D.count(spark, star, order).paths == 0
    with pytest.raises(ValueError):
        D.count(spark, star, order, form="packed")


def test_wide_states_survive_the_switch_to_spark(spark):
    n = 36
    ring = {v: sorted([(v - 1) % n, (v + 1) % n]) for v in range(n)}
    order = [*range(0, n, 2), *range(1, n, 2)]
    own, got = D.count(spark, ring, order), D.count(spark, ring, order, local_rows=2)
    assert got.steps[18][5] > 2 and got.steps[19][2] == 19  # the switch, with 18 slots
    assert (got.paths, got.cycles, got.steps) == (n, 1, own.steps)


def test_canonical():
    import numpy as np

    got = D.canonical(np.array([[0, 3, -1, 1, 3], [2, 2, 1, 0, -1]], np.int8))
    assert got.tolist() == [[0, 1, -1, 2, 1], [1, 1, 2, 0, -1]]
    assert (D.unpack(D.pack(got), 5) == got).all()


def test_ordering_of_a_run(spark):
    adj = G.square_sum(spark, 20).local()
    steps = D.step_table(spark, D.count(spark, adj, O.best_bfs(adj)))
    assert steps.count() == 20


def test_profile_of_a_run(spark, tmp_path):
    """What a run writes parses back with times, bags' edges and sizes as counted by hand."""
    adj = G.square_sum(spark, 25).local()
    order = O.best_bfs(adj)
    got = D.count(spark, adj, order)
    P.write_profile(D.profile_table(spark, adj, order, got), str(tmp_path / "log"))
    texts = spark.read.text(str(tmp_path / "log"), wholetext=True).selectExpr("'profile_25.txt' as name", "value as text")
    rows = P.parse_steps(texts).orderBy("step").collect()
    assert [(r.step, r.vertex, r.n_back, r.states_in, r.states_out) for r in rows] == [(k, v, back, a, b) for k, v, _, back, a, b in got.steps]
    for r in rows:
        done, ahead = set(order[: r.step + 1]), set(order[r.step + 1 :])
        bag = {v for v in done if ahead.intersection(adj[v])}
        assert r.fs == len(bag) and r.e_bag == sum(v < w for v in bag for w in adj[v] if w in bag)
    assert all(r.step_ms >= 0 for r in rows) and abs(rows[-1].cumul_ms - sum(got.ms)) < 0.1
    assert sum(got.ms) > 0


def test_multi_start_in_parallel(spark):
    adj = G.square_sum(spark, 15).local()
    starts = sorted((O.bfs(adj, s) for s in adj), key=lambda o: O.frontier_stats(adj, o))[:4]
    serial = sorted((O.anneal(adj, o, 100, 3 + i)[::2] for i, o in enumerate(starts)), key=lambda x: x[1])
    assert O.multi_start(spark, adj, 4, 100, 3) == serial[0][0]
    assert O.multi_start(spark, adj, 4, 100, 3, validate=lambda o: -O.frontier_stats(adj, o)[1]) == max((o for o, _ in serial), key=lambda o: O.frontier_stats(adj, o)[1])
