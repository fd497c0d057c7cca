import math
import random

import numpy as np
import pytest

from pathloom.operators import analytics as A, costmodel as C, enumeration as E, estimation as S, frontier as D, ordering as O, sat
from pathloom.sources import graphs as G, profiles as P


def test_enumeration_orbits_and_components(spark):
    g = G.square_sum(spark, 25)
    paths = E.numbered(E.spanning_paths(g)).persist()
    assert paths.count() == 10
    row = E.orbit_sizes(E.orbits(paths, g)).first()
    assert (row.orbits, row.paths) == (2, 10)
    rot = E.rotation_graph(paths, g).persist()
    assert rot.join(rot.selectExpr("dst as src", "src as dst"), ["src", "dst"], "left_anti").isEmpty()  # symmetric
    found = E.condensation(E.strong_components(paths.selectExpr("path_id as node"), rot), rot).collect()
    assert sorted(r["size"] for r in found) == row.sizes and all(r.is_source for r in found)


def test_strong_components_of_a_directed_graph(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long")
    nodes = spark.range(1, 8).selectExpr("id as node")
    scc = E.strong_components(nodes, arcs)
    groups = {}
    for r in scc.collect():
        groups.setdefault(r.scc, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5], [6], [7]]
    info = {r.scc: (r.in_degree, r.is_source) for r in E.condensation(scc, arcs).collect()}
    assert sorted(info.values()) == [(0, True), (0, True), (1, False), (1, False)]


def test_estimators(spark):
    adj = G.grid(spark, 3, 4).local()
    row = S.estimate(S.importance_samples(spark, adj, 4000, 2.0, 1)).first()
    assert abs(S.z_score(row["mean"], row["sem"], 62)) < 4
    again = S.estimate(S.importance_samples(spark, adj, 4000, 2.0, 1).repartition(3)).first()
    assert math.isclose(row["mean"], again["mean"])
    run = S.run_summary(S.particle_runs(spark, adj, 300, 12)).first()
    assert abs(S.z_score(run["mean"], run["sem"], 62)) < 4
    assert len(S.alpha_sweep(spark, adj, [1.0, 2.0], 50).collect()) == 2
    w = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0.1, 0.0, 0.7, 0.2])], "id int, w double")
    copies = [r.copies for r in S.systematic_resample(w, 10, 0.5).orderBy("id").collect()]
    assert sum(copies) == 10 and copies == [1, 0, 7, 2]
    trace = S.running_mean(spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "i int, x double"), "x", "i", 2).collect()
    assert [(r.i, r["mean"]) for r in trace] == [(2, 1.5), (4, 2.5), (6, 3.5)]


def test_profiles(spark, tmp_path):
    text = "n= 70  pw=14  max_fw=14  profile=824  ord=546.33s  dp=1635.171s  ham_paths=123456789012345678901\n0 5 1 0 1 1 0.1 0.1\n1 7 2 1 1 2 0.2 0.3\n1 7 2 1 1 3 0.2 0.3\nSA x\n2 9 3 2 4 3 6 0.3 0.6 {1} [ext]\n"
    (tmp_path / "profile_70.txt").write_text(text)
    (tmp_path / "profile_71.txt").write_text("0 1 1 0 1 2 0 0\n")
    texts = P.read_texts(spark, str(tmp_path))
    rows = P.parse_steps(texts).orderBy("n", "step").collect()
    assert [(r.n, r.step, r.states_out, r.e_bag, r.backend) for r in rows] == [(70, 0, 1, None, None), (70, 1, 3, None, None), (70, 2, 6, 4, "ext"), (71, 0, 2, None, None)]
    assert str(rows[0].ham_paths) == "123456789012345678901"
    P.write_profile(P.parse_steps(texts).where("n = 70"), str(tmp_path / "out"))
    assert P.parse_steps(P.read_texts(spark, str(tmp_path / "out"), "*")).count() == 3
    best = P.best_per_n(spark.createDataFrame([(1, "long_name", True, True), (1, "x", False, True), (1, "name", True, True)], "n int, name string, complete boolean, has_e_bag boolean"))
    assert best.first()["name"] == "name"
    got = P.solver_counts(spark.createDataFrame([("a", "s SATISFIABLE\nc s exact arb int 12\n"), ("b", "s UNSATISFIABLE\n")], "name string, text string")).orderBy("name").collect()
    assert [(r.status, int(r["count"])) for r in got] == [("SAT", 12), ("UNSAT", 0)]
    P.write_orders({"a": [3, 1, 2]}, str(tmp_path / "orders"))
    assert [r.v for r in P.read_order(spark, str(tmp_path / "orders" / "order_a.txt")).orderBy("pos").collect()] == [3, 1, 2]
    (tmp_path / "c.yaml").write_text("refine-iters: 5 # few\n")
    assert P.read_settings(str(tmp_path / "c.yaml")) == {"refine_iters": "5"}


def test_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    fit = A.least_squares(df, ["a", "b"], "y")
    want, *_ = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    assert np.allclose(fit["coef"], want) and fit["r2"] > 0.99 and all(p < 1e-6 for p in fit["p"])
    (_, r, p), *_ = A.correlations(df, ["a"], "y")
    assert math.isclose(r, np.corrcoef(x[:, 0], y)[0, 1]) and p < 1e-6
    assert math.isclose(A.t_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(A.t_two_sided(0.5, 3), 0.651447964848, rel_tol=1e-9)
    scaled, scale = A.standardise(df.selectExpr("a", "1D as one"), ["a", "one"])
    assert scale["one"] == (1.0, 1.0) and abs(scaled.groupBy().avg("a").first()[0]) < 1e-9
    lse = A.log_sum_exp(spark.createDataFrame([(1, 1000.0), (1, 1000.0)], "k int, x double"), "x", "k").first()
    assert math.isclose(lse.lse, 1000 + math.log(2))


def test_features_and_models(spark):
    adj = G.square_sum(spark, 25).local()
    steps = D.step_table(spark, D.count(spark, adj)).selectExpr("0 as profile_id", "25 as n", "*", "cast(null as int) as e_bag")
    rows = A.with_features(steps).orderBy("step").collect()
    assert all(r.states_in > 1 for r in rows) and rows[0].prev_log_ratio == 0
    assert rows[1].delta_fs == rows[1].fs - rows[0].fs or rows[1].step - rows[0].step > 1
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = np.maximum(x[:, 0], 0) + 0.5 * x[:, 1]
    groups = np.repeat([0, 1, 2], 40)
    mlp = C.train(x, y, epochs=400, dropout=0.0) | {"features": ["a", "b", "c"]}
    conv = C.train(x, y, taps=5, groups=groups, epochs=400, dropout=0.0)
    assert mlp["r2"] > 0.9 and conv["r2"] > 0.7
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:10]], "a double, b double, c double")
    got = [r.predicted for r in C.predict(df, mlp).collect()]
    assert np.allclose(got, C.infer(mlp, x[:10]))
    assert np.allclose([r[0] for r in df.selectExpr(C.sql_of(mlp)).collect()], got)
    linear = {"features": ["intercept", "a"], "coef": [1.0, 2.0]}
    assert C.predict(df, linear).selectExpr("max(abs(predicted - 1 - 2 * a))").first()[0] < 1e-12
    order = O.best_bfs(adj)
    assert C.order_cost(None, adj, order) > 0
    assert C.order_cost(None, adj, order, safe_log=1.0) > C.order_cost(None, adj, order)


def test_sat(spark):
    for g, cycles in ((G.complete(spark, 3), 1), (G.grid(spark, 2, 2), 1), (G.grid(spark, 1, 3), 0)):
        clauses, variables = sat.encode(g)
        lits = [r.lits for r in clauses.collect()]
        show = [r.id for r in variables.where("kind = 'arc'").collect()]
        assert sat.count_models(lits, show) == 2 * cycles  # both directions
    lines = [r.value for r in sat.cnf_lines(clauses, variables).orderBy("i").collect()]
    assert any(x.startswith("p cnf") for x in lines) and any(x.startswith("c p show") and x.endswith(" 0") for x in lines)


def test_streaming(spark, tmp_path):
    from pathloom.streaming import running_moments

    spark.createDataFrame([(1.0,), (3.0,)], "w double").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("w double").json(str(tmp_path / "in"))
    q = running_moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.table("moments").first()
    assert (row.samples, row["mean"]) == (2, 2.0)


def test_cli_parses_and_counts(spark, capsys, tmp_path):
    from pathloom import cli

    (tmp_path / "c").write_text("start: 25\ncycles: true\nnonsense: 1\n")
    cli.main(["--config", str(tmp_path / "c"), "count", "--no-pw", "--refine-iters", "50", "--sa-t-start", "5", "--sa-t-end", "0.1", "--profile", str(tmp_path / "log")])
    got = capsys.readouterr()
    assert "ham_paths=10" in got.out and "ham_cycles=0" in got.out and "nonsense" in got.err
    assert spark.read.text(str(tmp_path / "log")).where("value rlike '[{][0-9,]+[}] .sm.$'").count() == 24  # the last step leaves none


@pytest.mark.parametrize("name", ["ham_paths_nation", "edges_nation", "degree_stats", "canonical_states"])
def test_registered_queries_against_duckdb(spark, name):
    import duckdb

    from pathloom.plans import registry

    db = duckdb.connect()
    db.execute("create view nation as select * from '/root/testdata/sf0.001/nation.parquet'")
    got = registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = db.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_log_sum_exp_of_far_apart_values_and_nulls(spark):
    rows = [("a", 1000.0), ("a", 1000.5), ("a", -3000.0), ("b", None), ("c", -700.0), ("c", None), (None, 2.0), (None, 2.0)]
    got = {r.k: r.lse for r in A.log_sum_exp(spark.createDataFrame(rows, "k string, x double"), "x", "k").collect()}
    want = {"a": 1000.5 + math.log1p(math.exp(-0.5)), "b": None, "c": -700.0, None: 2 + math.log(2)}
    assert got.keys() == want.keys() and got["b"] is None
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items() if v is not None)
    whole = A.log_sum_exp(spark.createDataFrame([(0.0,), (0.0,)], "x double"), "x").first()
    assert abs(whole.lse - math.log(2)) < 1e-12


def test_systematic_resample_against_plain_targets(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([0.0, rng.random(), 9.0])) for k in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id long, w double").repartition(5)
    got = {(r.k, r.id): r.copies for r in S.systematic_resample(df, 40, 0.3, key_col="k").collect()}
    for key in ("a", "b", None):
        own = [(i, w) for k, i, w in rows if k == key]
        total, reach, left = sum(w for _, w in own), 0.0, [(t + 0.3) / 40 for t in range(40)]
        for i, w in own:
            reach += w
            hit = [t for t in left if t <= reach / total + 1e-12]
            left = left[len(hit) :]
            assert got[key, i] == len(hit)


def test_counting_leaves_the_users_cache_alone(spark):
    mine = spark.range(10).persist()
    mine.count()
    adj, before = G.square_sum(spark, 15).local(), spark.sparkContext._jsc.getPersistentRDDs().size()
    assert D.count(spark, adj, form="packed").paths == D.count(spark, adj, form="native").paths == 1
    assert mine.storageLevel.useMemory and spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    mine.unpersist()
