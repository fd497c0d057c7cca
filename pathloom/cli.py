"""Command line: count, write, estimate and analyse.

    python -m pathloom.cli count 15 30 --cycles
    python -m pathloom.cli count --graph g.dimacs --order bfs+sa --form packed --checkpoint /shared/run
    python -m pathloom.cli write grid 4 4 --out g.dimacs --root
    python -m pathloom.cli estimate 57 --samples 100000 --alpha 2
    python -m pathloom.cli particles 25 --samples 1000 --runs 8
    python -m pathloom.cli analyse logs/ --save-model model.json

``--config`` names a file of ``key: value`` lines that become defaults; options
on the command line win, unknown keys are warned of.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .operators import analytics, costmodel, estimation, frontier, ordering
from .sources import graphs, profiles


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--config", help="file of defaults")
    top.add_argument("--seed", type=int, default=42)
    sub = top.add_subparsers(dest="command", required=True)
    count = sub.add_parser("count", help="exact counts")
    count.add_argument("start", type=int, nargs="?", default=15)
    count.add_argument("end", type=int, nargs="?")
    count.add_argument("--graph", help="DIMACS file instead of square-sum graphs")
    count.add_argument("--order", default="beam", choices=sorted(ordering.METHODS))
    count.add_argument("--multi-start", type=int, default=0, help="anneal so many starts")
    count.add_argument("--validate", type=int, default=0, help="rank the ten cheapest by the states of so many steps")
    count.add_argument("--refine-iters", type=int, default=0)
    count.add_argument("--expand-base", type=float, default=1.55)
    count.add_argument("--density-alpha", type=float, default=0.25)
    count.add_argument("--spike-penalty", type=float, default=0.0)
    count.add_argument("--schedule", default="geometric", choices=["geometric", "linear", "cosine", "log"])
    count.add_argument("--sa-t-start", type=float, default=0.0, help="first temperature (0: 5 %% of the first cost)")
    count.add_argument("--sa-t-end", type=float, default=0.0, help="last temperature (0: 0.01 %% of the first cost)")
    count.add_argument("--no-pw", action="store_true", help="the best breadth-first order, whatever --order says")
    count.add_argument("--no-refine", action="store_true", help="no annealing, whatever --refine-iters says")
    count.add_argument("--restarts", type=int, default=0)
    count.add_argument("--restart-factor", type=float, default=0.5)
    count.add_argument("--bound", type=int, help="largest width that an order may have")
    count.add_argument("--model", help="model file that prices orders")
    count.add_argument("--form", default="auto", choices=["auto", "local", "packed", "native"])
    count.add_argument("--cycles", action="store_true")
    count.add_argument("--checkpoint")
    count.add_argument("--checkpoint-every", type=int, default=5)
    count.add_argument("--profile", help="file for the step profile")
    write = sub.add_parser("write", help="write a graph")
    write.add_argument("family", choices=sorted(graphs.FAMILIES))
    write.add_argument("sizes", type=int, nargs="+")
    write.add_argument("--out", required=True)
    write.add_argument("--form", default="edge", choices=["edge", "gb"])
    write.add_argument("--root", action="store_true")
    for name in ("estimate", "particles"):
        est = sub.add_parser(name)
        est.add_argument("n", type=int, nargs="?", default=57)
        est.add_argument("--samples", type=int, default=100_000 if name == "estimate" else 1000)
        est.add_argument("--truth", type=float)
        if name == "estimate":
            est.add_argument("--alpha", type=float, nargs="+", default=[2.0])
        else:
            est.add_argument("--runs", type=int, default=1)
            est.add_argument("--threshold", type=float, default=0.5)
            est.add_argument("--no-resample", action="store_true")
    analyse = sub.add_parser("analyse", help="fit models to profile logs")
    analyse.add_argument("paths", nargs="+")
    analyse.add_argument("--best-only", action="store_true")
    analyse.add_argument("--save-model")
    analyse.add_argument("--save-sql")
    return top


def order_for(spark: SparkSession, adj: ordering.Adjacency, a: argparse.Namespace) -> list[int]:
    """The order that the options ask for: a method, refined by annealing, or the best of many starts."""
    if a.multi_start:
        validate = (lambda o: sum(s[5] for s in frontier.count(spark, adj, o, "local", step_limit=a.validate).steps)) if a.validate else None
        return ordering.multi_start(spark, adj, a.multi_start, a.refine_iters or 2000, a.seed, validate)
    order = ordering.best_bfs(adj) if a.no_pw else ordering.best_order(adj, a.order)
    if a.refine_iters and not a.no_refine:
        price = costmodel.cost_function(profiles.read_model(a.model)) if a.model else (lambda g, o: ordering.proxy_cost(g, o, a.expand_base, a.density_alpha, a.spike_penalty, a.bound))
        order = ordering.anneal(adj, order, a.refine_iters, a.seed, price, a.schedule, a.sa_t_start, a.sa_t_end, restarts=a.restarts, factor=a.restart_factor, bound=a.bound)[0]
    return order


def summary_line(label: str, c: frontier.Counted, ord_s: float, dp_s: float, cycles: bool) -> str:
    line = f"{label}  max_fw={c.max_fw}  profile={c.profile}  ord={ord_s:.2f}s  dp={dp_s:.3f}s  ham_paths={c.paths}"
    return line + (f"  ham_cycles={c.cycles}" if cycles else "")


def _count(spark: SparkSession, a: argparse.Namespace) -> None:
    named = [(a.graph, graphs.read_dimacs(spark, a.graph))] if a.graph else [(f"n= {n}", graphs.square_sum(spark, n)) for n in range(a.start, (a.end or a.start) + 1)]
    for label, graph in named:
        adj, t = graph.local(), time.perf_counter()
        order = order_for(spark, adj, a)
        ordered = time.perf_counter()
        got = frontier.count(spark, adj, order, a.form, checkpoint=a.checkpoint, every=a.checkpoint_every)
        print(summary_line(label, got, ordered - t, time.perf_counter() - ordered, a.cycles), flush=True)
        if a.profile:
            profiles.write_profile(frontier.profile_table(spark, adj, order, got), a.profile)


def _estimate(spark: SparkSession, a: argparse.Namespace) -> None:
    adj = graphs.square_sum(spark, a.n).local()
    if a.command == "particles":
        row = estimation.run_summary(estimation.particle_runs(spark, adj, a.samples, a.runs, a.seed, a.threshold, not a.no_resample)).first()
        rows = [row]
    else:
        rows = estimation.alpha_sweep(spark, adj, a.alpha, a.samples, a.seed).collect()
    for row in rows:
        print("  ".join(f"{k}={v:.6g}" for k, v in row.asDict().items() if v is not None), end="")
        print(f"  z={estimation.z_score(row['mean'], row['sem'] or 0.0, a.truth):.2f}" if a.truth else "")


def _analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    from pyspark.sql import Window, functions as F

    steps = profiles.parse_steps(profiles.read_texts(spark, a.paths))
    if a.best_only:
        known = steps.groupBy("n", "name").agg(F.bool_or(F.col("ham_paths").isNotNull()).alias("complete"), F.bool_or(F.col("e_bag").isNotNull()).alias("has_e_bag"))
        steps = steps.join(profiles.best_per_n(known).select("name"), "name", "left_semi")
    names = steps.select("name").distinct().withColumn("profile_id", F.row_number().over(Window.orderBy("name")))
    rows = analytics.with_features(steps.join(names, "name")).persist()
    analytics.summary_per_n(rows).orderBy("n").show()
    found = ["fs", "n_back", "delta_fs", "prev_log_ratio"]
    for name, r, p in analytics.correlations(rows, analytics.FEATURES, "log_ratio"):
        print(f"{name:16s} r={r:.4f} p={p:.3g}")
    linear = analytics.least_squares(rows, found, "log_ratio")
    print("linear", {k: linear[k] for k in ("r2", "rmse", "n_obs")})
    frame = rows.where("log_ratio is not null").select("profile_id", "step", *found, "log_ratio").toPandas().sort_values(["profile_id", "step"])
    models = [linear | {"name": "linear"}]
    for name, taps in (("mlp", 0), ("conv", 5)):
        m = costmodel.train(frame[found].to_numpy(float), frame["log_ratio"].to_numpy(float), taps=taps, groups=frame["profile_id"].to_numpy())
        models.append(m | {"name": name, "features": found})
        print(name, {k: m[k] for k in ("r2", "rmse", "n_obs")})
    best = max(models, key=lambda m: m["r2"])
    if a.save_model:
        profiles.write_model(best, a.save_model)
    if a.save_sql:
        with open(a.save_sql, "w") as f:
            f.write(costmodel.sql_of(linear))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = _parser()
    if "--config" in argv:
        settings = profiles.read_settings(argv[argv.index("--config") + 1])
        parts = [parser, *parser._subparsers._group_actions[0].choices.values()]
        known = {x.dest: x for p in parts for x in p._actions}
        for key in settings.keys() - known.keys():
            print(f"unknown setting {key}", file=sys.stderr)
        for p in parts:
            p.set_defaults(**{x.dest: (settings[x.dest] in ("true", "yes", "1") if x.nargs == 0 else (x.type or str)(settings[x.dest])) for x in p._actions if x.dest in settings})
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    if a.command == "write":
        graphs.write_dimacs(graphs.family(spark, a.family, *a.sizes), a.out, a.form, a.root)
    else:
        {"count": _count, "estimate": _estimate, "particles": _estimate, "analyse": _analyse}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
