"""Models of the DP's growth per step: features of an ordering, linear and neural models, their cost of an order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import ordering as O

STEP_FEATURES = ["fs", "n_back", "n_leave", "delta_fs", "e_bag", "fs_sq", "fs_nb", "nb_sq", "step_frac", "nb_fs_ratio", "prev_log_ratio"]
SPILL = math.log(2.5)  # an external pass costs about this much more


def step_features(adj: O.Adjacency, order: list[int]) -> np.ndarray:
    """A row a step of STEP_FEATURES; the last is 0 until a first pass predicts it."""
    at, last, widths = {v: i for i, v in enumerate(order)}, O.last_steps(adj, order), O.widths(adj, order)
    rows, frontier = [], set()
    for i, v in enumerate(order):
        frontier.add(v)
        fs, nb = len(frontier), sum(at[w] < i for w in adj[v])
        inside = sum(w in frontier for x in frontier for w in adj[x]) // 2
        gone = {x for x in frontier if last[at[x]] <= i}
        rows.append([fs, nb, len(gone), widths[i] - (widths[i - 1] if i else 0), inside, fs * fs, fs * nb, nb * nb, i / max(1, len(order)), nb / max(1, fs), 0.0])
        frontier -= gone
    return np.array(rows, float).reshape(-1, len(STEP_FEATURES))


def _act(x: np.ndarray, kind: str | None) -> np.ndarray:
    return np.maximum(x, 0) if kind == "relu" else x


def infer(model: dict, x: np.ndarray) -> np.ndarray:
    """Predicted log ratios of rows in sequence: linear (``coef``), MLP (``layers``), or with a convolution before (``conv_kernel``)."""
    if "coef" in model:
        coef = np.asarray(model["coef"], float)
        return x @ coef[-x.shape[1] :] + (coef[0] if len(coef) > x.shape[1] else 0.0)
    x = (x - np.asarray(model["input_mean"])) / np.asarray(model["input_std"])
    if "conv_kernel" in model:
        kernel = np.asarray(model["conv_kernel"])  # (taps, inputs, filters)
        half = len(kernel) // 2
        padded = np.pad(x, ((half, half), (0, 0)))
        x = np.maximum(sum(padded[i : i + len(x)] @ kernel[i] for i in range(len(kernel))) + np.asarray(model["conv_bias"]), 0)
    for layer in model["layers"]:
        x = _act(x @ np.asarray(layer["W"]) + np.asarray(layer["b"]), layer.get("activation"))
    return x[:, 0]


def order_cost(model: dict | None, adj: O.Adjacency, order: list[int], base: float = 1.55, safe_log: float | None = None, spill_log: float | None = None) -> float:
    """Log of the sum of predicted states over steps.

    Two passes: the first predicts every step with the previous ratio 0, the second uses the first's predictions. Without
    a model a step grows by ``base`` to its back edges. States above ``safe_log`` are penalised by squares, those above
    ``spill_log`` cost an external pass more.
    """
    x = step_features(adj, order)
    if model is None:
        ratio = x[:, 1] * math.log(base)
    else:
        x[1:, -1] = infer(model, x)[:-1]
        ratio = infer(model, x)
    logs = np.maximum(np.cumsum(ratio), 0.0)
    if spill_log is not None:
        logs = logs + SPILL * (logs > spill_log)
    top = logs.max(initial=0.0)
    total = top + math.log(np.exp(logs - top).sum())
    return total + (20 * np.maximum(logs - safe_log, 0) ** 2).sum() if safe_log is not None else total


def cost_function(model: dict | None):
    """A cost for :func:`ordering.anneal`."""
    return lambda adj, order: order_cost(model, adj, order)


def train(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (16, 8), taps: int = 0, filters: int = 8, groups: np.ndarray | None = None, epochs: int = 300, rate: float = 0.01, l2: float = 1e-4, dropout: float = 0.1, seed: int = 0) -> dict:
    """An MLP by Adam; with ``taps`` a convolution along each group's rows comes first. Inputs are standardised by population moments."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = (x - mean) / std
    if taps:
        half, window = taps // 2, np.zeros((len(z), taps, z.shape[1]))
        for g in np.unique(groups) if groups is not None else [None]:
            rows = np.flatnonzero(groups == g) if g is not None else np.arange(len(z))
            padded = np.pad(z[rows], ((half, half), (0, 0)))
            for i in range(taps):
                window[rows, i] = padded[i : i + len(rows)]
        z = window.reshape(len(z), -1)
    sizes = [z.shape[1], *([filters] if taps else []), *hidden, 1]
    params = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        acts, masks, h = [z], [], z
        for i in range(0, len(params), 2):
            h = h @ params[i] + params[i + 1]
            if i < len(params) - 2:
                keep = (rng.random(h.shape) >= dropout) / (1 - dropout) if dropout else 1.0
                masks.append((h > 0) * keep)
                h = h * masks[-1]
            acts.append(h)
        g = 2 * (h[:, 0] - y)[:, None] / len(y)
        grads = []
        for i in range(len(params) - 2, -1, -2):
            grads = [acts[i // 2].T @ g + 2 * l2 * params[i], g.sum(0), *grads]
            if i:
                g = (g @ params[i].T) * masks[i // 2 - 1]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = {"input_mean": mean.tolist(), "input_std": std.tolist(), "n_obs": len(y)}
    if taps:
        model |= {"conv_kernel": params[0].reshape(taps, x.shape[1], filters).tolist(), "conv_bias": params[1].tolist(), "conv_kernel_size": taps, "conv_n_filters": filters}
        params = params[2:]
    model["layers"] = [{"W": params[i].tolist(), "b": params[i + 1].tolist(), "activation": "relu" if i < len(params) - 2 else None} for i in range(0, len(params), 2)]
    got = np.concatenate([infer(model, x[groups == g]) for g in np.unique(groups)]) if groups is not None else infer(model, x)
    want = np.concatenate([y[groups == g] for g in np.unique(groups)]) if groups is not None else y
    return model | {"r2": float(1 - ((got - want) ** 2).mean() / max(1e-12, want.var())), "rmse": float(np.sqrt(((got - want) ** 2).mean()))}


def leave_one_out(rows: DataFrame, features: list[str], target: str = "log_ratio", key: str = "profile_id", **options) -> DataFrame:
    """(fold, r2, n): a model for each profile left out, trained in parallel, one fold a group.

    Profiles are bounded (a row a step), so each fold's task gets all of them.
    """
    frame = rows.select(key, "step", *features, target).toPandas().sort_values([key, "step"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for folds in frames:
            out = []
            for fold in folds["fold"]:
                inside, outside = frame[frame[key] != fold], frame[frame[key] == fold]
                model = train(inside[features].to_numpy(float), inside[target].to_numpy(float), groups=inside[key].to_numpy(), **options)
                d = infer(model, outside[features].to_numpy(float)) - outside[target].to_numpy(float)
                out.append((int(fold), float(1 - (d * d).mean() / max(1e-12, outside[target].var(ddof=0))), len(outside)))
            yield pd.DataFrame(out, columns=["fold", "r2", "n"])

    keys = rows.select(F.col(key).cast("int").alias("fold")).distinct()
    return keys.repartition("fold").mapInPandas(run, "fold int, r2 double, n int")


def predict(df: DataFrame, model: dict, out: str = "predicted") -> DataFrame:
    """Row-wise prediction: a linear model as a native expression, a network as an Arrow UDF."""
    names = model["features"]
    if "coef" in model:
        return df.withColumn(out, linear_expression(model))

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(infer(model, np.stack([c.to_numpy(float) for c in columns], 1)))

    return df.withColumn(out, run(*[F.col(c) for c in names]))


def linear_expression(model: dict) -> Column:
    terms = [F.lit(float(b)) * (F.lit(1.0) if c == "intercept" else F.col(c)) for c, b in zip(model["features"], model["coef"], strict=True)]
    return sum(terms[1:], terms[0])


def sql_of(model: dict) -> str:
    """A model's prediction as a SQL expression over its features."""
    if "coef" in model:
        return " + ".join(f"({b!r})" if c == "intercept" else f"({b!r}) * {c}" for c, b in zip(model["features"], model["coef"], strict=True))
    x = [f"(({c}) - ({m!r})) / ({s!r})" for c, m, s in zip(model["features"], model["input_mean"], model["input_std"], strict=True)]
    for layer in model["layers"]:
        sums = [" + ".join([f"({layer['b'][j]!r})", *(f"({layer['W'][i][j]!r}) * ({x[i]})" for i in range(len(x)))]) for j in range(len(layer["b"]))]
        x = [f"greatest(0D, {s})" if layer["activation"] == "relu" else f"({s})" for s in sums]
    return x[0]


def compare(steps: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("profile_id", "step")) -> DataFrame:
    """Actual beside predicted log ratios of the same steps; those without output states are left out."""
    return steps.where("states_out > 0").join(predicted, list(keys)).select(*keys, "log_ratio", "predicted", (F.col("predicted") - F.col("log_ratio")).alias("err"))
