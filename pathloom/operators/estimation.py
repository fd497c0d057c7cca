"""Estimates of the number of paths through every vertex: importance sampling and a particle filter.

A sample's random numbers come from a counter-based generator seeded by (seed,
sample), so results depend on neither partitioning nor retries. Samples are
rows; moments are ordinary aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import ordering as O


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.random.SeedSequence(key).generate_state(2, np.uint64)))


def sample_path(adj: O.Adjacency, alpha: float, rng: np.random.Generator) -> tuple[list[int] | None, float]:
    """A self-avoiding walk: uniform start, next vertex by (free neighbours) ** -alpha (1 where none is left). Path or None, and log q."""
    names = list(adj)
    free = {v: len(ws) for v, ws in adj.items()}
    v = names[int(rng.integers(len(names)))]
    log_q, path, seen = -math.log(len(names)), [v], {v}
    while True:
        for w in adj[v]:
            free[w] -= 1
        if len(path) == len(names):
            return path, log_q
        near = [w for w in adj[v] if w not in seen]
        if not near:
            return None, log_q
        weight = np.array([free[w] ** -alpha if free[w] else 1.0 for w in near])
        weight /= weight.sum()
        i = int(np.searchsorted(np.cumsum(weight), rng.random()))
        i = min(i, len(near) - 1)
        log_q += math.log(weight[i])
        v = near[i]
        path.append(v)
        seen.add(v)


def importance_samples(spark: SparkSession, adj: O.Adjacency, m: int, alpha: float | list[float] = 2.0, seed: int = 42) -> DataFrame:
    """(alpha, sample_id, completed, log_q); several alphas share the seed."""
    alphas = alpha if isinstance(alpha, list) else [alpha]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, i in zip(frame["alpha"], frame["sample_id"], strict=True):
                path, log_q = sample_path(adj, a, _rng(seed, i))
                rows.append((a, i, path is not None, log_q))
            yield pd.DataFrame(rows, columns=["alpha", "sample_id", "completed", "log_q"])

    ids = spark.range(m).select(F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"), F.col("id").alias("sample_id"))
    return ids.mapInPandas(run, "alpha double, sample_id bigint, completed boolean, log_q double")


def moments(weight: Column) -> list[Column]:
    """Mean, standard error, CV of the non-zero weights, share of non-zero, effective variance, ESS and 95 % interval."""
    mean, hit = F.avg(weight), F.when(weight > 0, weight)
    sem = F.stddev_samp(weight) / F.sqrt(F.count(weight))
    cv = F.stddev_samp(hit) / F.avg(hit)
    rate = F.avg((weight > 0).cast("double"))
    return [
        F.count(weight).alias("samples"), mean.alias("mean"), sem.alias("sem"), cv.alias("cv"), rate.alias("completion"), ((1 + cv * cv) / rate).alias("eff_var"),
        (F.sum(weight) * F.sum(weight) / F.nullif(F.sum(weight * weight), F.lit(0.0))).alias("ess"), (mean - 1.96 * sem).alias("low"), (mean + 1.96 * sem).alias("high"),
    ]


def estimate(samples: DataFrame) -> DataFrame:
    """A row an alpha: undirected paths are half the directed mean of 1/q over completed samples."""
    weight = F.when(F.col("completed"), F.exp(-F.col("log_q")) / 2).otherwise(0.0)
    return samples.withColumn("w", weight).groupBy("alpha").agg(*moments(F.col("w")))


def alpha_sweep(spark: SparkSession, adj: O.Adjacency, alphas: list[float], m: int, seed: int = 42) -> DataFrame:
    return estimate(importance_samples(spark, adj, m, alphas, seed)).orderBy("alpha")


def z_score(mean: float, sem: float, truth: float) -> float:
    return (mean - truth) / sem if sem else (0.0 if mean == truth else math.inf)


PIECES = 64


def running_mean(df: DataFrame, value: str, order: str, every: int = 1) -> DataFrame:
    """(order, mean so far), every so many rows. One ordered pass: for traces of a run, not for raw data."""
    frame = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select(order, F.avg(value).over(frame).alias("mean"), F.row_number().over(Window.orderBy(order)).alias("n"))
    return out.where(F.col("n") % every == 0).select(order, "mean")


def systematic_resample(weights: DataFrame, m: int, u0: float, id_col: str = "id", weight_col: str = "w", key_col: str | None = None) -> DataFrame:
    """(id, copies): how many of the m targets (k + u0) / m fall into each row's share of the cumulative weight.

    The range join of targets with shares is solved in closed form: the number of targets up to a cumulative share c is
    ceil(m c - u0), so a row's copies are a difference of two of these. With ``key_col`` runs are resampled side by side.

    Cumulative weights take two passes: sums of PIECES ranges of ids, whose running totals are a small table, then a
    window within each range, so a run of any length is no single task. Ids are numbers or times.
    """
    keys = [key_col] if key_col else []
    cuts = weights.agg(F.percentile_approx(id_col, [i / PIECES for i in range(1, PIECES)], 10_000).alias("cuts"))
    pieced = weights.join(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter("cuts", lambda c: c < F.col(id_col)))).drop("cuts")
    sums = pieced.groupBy(*[F.col(k).alias("_key") for k in keys], "_piece").agg(F.sum(weight_col).alias("_own"))
    by_key = Window.partitionBy(*(["_key"] if keys else []))
    before = F.coalesce(F.sum("_own").over(by_key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select(*(["_key"] if keys else []), F.col("_piece").alias("_at"), before.alias("_before"), F.sum("_own").over(by_key).alias("_t"))
    same = (F.col("_piece") == F.col("_at")) & (F.col(key_col).eqNullSafe(F.col("_key")) if keys else F.lit(True))
    placed = pieced.join(sums, same)
    within = F.sum(weight_col).over(Window.partitionBy(*keys, "_piece").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))

    def upto(reached):
        return F.least(F.lit(m), F.greatest(F.lit(0), F.ceil(m * reached / F.col("_t") - u0 - 1e-12))).cast("long")

    counted = placed.withColumn("_n", upto(F.col("_before") + within))
    last = F.lag("_n").over(Window.partitionBy(*keys, "_piece").orderBy(id_col))
    return counted.withColumn("copies", F.col("_n") - F.coalesce(last, upto(F.col("_before")))).select(*weights.columns, "copies")


class Particle:
    """A partial choice of edges: which end each segment's other end is, vertices that may still take an edge, and its log weight."""

    __slots__ = ("degree", "log_w", "mate", "open_ends", "segments")

    def __init__(self):
        self.mate: dict[int, int] = {}
        self.degree: dict[int, int] = {}
        self.open_ends, self.segments, self.log_w = 0, 0, 0.0

    def copy(self) -> Particle:
        new = Particle()
        new.mate, new.degree = dict(self.mate), dict(self.degree)
        new.open_ends, new.segments, new.log_w = self.open_ends, self.segments, self.log_w
        return new


def _choices(p: Particle, back: list[int]) -> list[tuple[int, ...]]:
    """Sets of at most two earlier neighbours that the new vertex may be joined to without a cycle."""
    free = [w for w in back if p.degree[w] < 2]
    return [(), *((w,) for w in free), *((a, b) for i, a in enumerate(free) for b in free[i + 1 :] if p.mate[a] != b)]


def _placed(p: Particle, v: int, chosen: tuple[int, ...], leave: list[int], final: bool) -> Particle | None:
    """The particle after v is joined to ``chosen`` and ``leave`` have left, or None if it can't become one path."""
    q = p.copy()
    q.mate[v], q.degree[v] = v, len(chosen)
    q.segments += 1 - len(chosen)
    for w in chosen:
        a, b = q.mate[v], q.mate[w]
        q.degree[w] += 1
        q.mate[a], q.mate[b] = b, a
    for u in leave:
        if q.degree[u] == 0:
            return None
        q.open_ends += q.degree[u] == 1
        if q.open_ends > 2:
            return None
    if q.open_ends == 2 and not final:
        gone = set(leave)
        ends = [x for x in q.degree if q.degree[x] == 1 and q.mate[x] in q.degree and q.degree[q.mate[x]] == 1]
        # A segment whose two ends have left is whole; nothing else may come.
        if any(x in gone and q.mate[x] in gone for x in ends) or any(q.mate[x] == -1 for x in gone if q.degree[x] == 1):
            return None
    for u in leave:
        if q.degree[u] == 1:
            q.mate[q.mate[u]] = -1 if q.mate[u] != u else q.mate[u]
    for u in leave:
        del q.degree[u]
    return q


def particle_filter(adj: O.Adjacency, m: int, seed: int, run: int = 0, threshold: float = 0.5, order: list[int] | None = None, resample: bool = True) -> tuple[float, float]:
    """(estimate of the undirected paths, smallest ESS share): sequential choice of edges, weights by the number of choices."""
    order = O.best_bfs(adj, True) if order is None else order
    at, last = {v: i for i, v in enumerate(order)}, O.last_steps(adj, order)
    rng = _rng(seed, run)
    particles, logs = [Particle() for _ in range(m)], np.zeros(m)
    scale, worst = 0.0, 1.0
    for k, v in enumerate(order):
        back = [w for w in adj[v] if at[w] < k]
        leave = [u for i, u in enumerate(order[: k + 1]) if last[i] == k]
        alive, new_logs = [], []
        for p, lw in zip(particles, logs, strict=True):
            good = [q for c in _choices(p, back) if (q := _placed(p, v, c, leave, k == len(order) - 1)) is not None]
            if good:
                alive.append(good[int(rng.integers(len(good)))])
                new_logs.append(lw + math.log(len(good)))
        if not alive:
            return 0.0, 0.0
        particles, logs = alive, np.array(new_logs)
        w = np.exp(logs - logs.max())
        ess = w.sum() ** 2 / (w * w).sum()
        worst = min(worst, ess / m)
        if resample and (ess < threshold * m or len(alive) < m) and k < len(order) - 1:
            scale += logs.max() + math.log(w.sum() / m)
            targets = (np.arange(m) + rng.random()) / m
            pick = np.minimum(np.searchsorted(np.cumsum(w) / w.sum(), targets), len(alive) - 1)
            particles, logs = [particles[i] for i in pick], np.zeros(m)
    final = [lw for p, lw in zip(particles, logs, strict=True) if p.segments == 1]
    total = sum(math.exp(x) for x in final) / m if final else 0.0
    return total * math.exp(scale), worst


def particle_runs(spark: SparkSession, adj: O.Adjacency, m: int = 1000, runs: int = 8, seed: int = 42, threshold: float = 0.5, resample: bool = True) -> DataFrame:
    """(run, estimate, ess): independent filters, one row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r, *particle_filter(adj, m, seed, r, threshold, resample=resample)) for r in frame["run"]], columns=["run", "estimate", "ess"])

    rows = spark.range(runs).select(F.col("id").cast("int").alias("run")).repartition(min(runs, spark.sparkContext.defaultParallelism))
    return rows.mapInPandas(run, "run int, estimate double, ess double")


def run_summary(runs: DataFrame) -> DataFrame:
    """Mean, spread, CV and standard error over runs."""
    return runs.agg(F.count("*").alias("runs"), F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("std"), (F.stddev_samp("estimate") / F.avg("estimate")).alias("cv"), (F.stddev_samp("estimate") / F.sqrt(F.count("*"))).alias("sem"), F.min("ess").alias("ess"))
