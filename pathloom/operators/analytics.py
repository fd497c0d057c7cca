"""Analytics over step profiles and any numeric table: features, windows, correlation, least squares.

Everything is built-in expressions; what reaches the driver is one row of sums.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

FEATURES = ["fs", "n_back", "e_bag", "fs_sq", "fs_nb", "nb_sq", "fs_eb", "nb_eb", "eb_sq", "delta_fs", "step_frac", "nb_fs_ratio", "prev_log_ratio"]


def with_features(steps: DataFrame, key: str = "profile_id") -> DataFrame:
    """Derived columns of each step. ``delta_fs`` looks at all steps, the rest leave the warm-up (one state or fewer) out."""
    over = Window.partitionBy(key).orderBy("step")
    fs, nb, eb = F.col("fs"), F.col("n_back"), F.coalesce("e_bag", F.lit(0))
    before = steps.withColumn("prev_fs", F.lag("fs", 1, 0).over(over)).withColumn("delta_fs", fs - F.col("prev_fs"))
    ratio = F.when((F.col("states_in") > 0) & (F.col("states_out") > 0), F.ln(F.col("states_out") / F.col("states_in")))
    rows = before.where("states_in > 1").withColumns({
        "log_ratio": ratio, "log_states_in": F.ln("states_in"), "fs_sq": fs * fs, "fs_nb": fs * nb, "nb_sq": nb * nb, "fs_eb": fs * eb, "nb_eb": nb * eb, "eb_sq": eb * eb,
        "dedup": F.col("states_out") / F.col("states_in"), "step_frac": F.col("step") / F.greatest("n", F.lit(1)), "nb_fs_ratio": nb / F.greatest(fs, F.lit(1)),
    })
    return rows.withColumn("prev_log_ratio", F.coalesce(F.lag("log_ratio").over(over), F.lit(0.0)))


def summary_per_n(steps: DataFrame) -> DataFrame:
    return steps.groupBy("n").agg(F.max("states_out").alias("peak"), F.sum("states_out").alias("total"), F.count("*").alias("steps"))


def peak_against_total(per_n: DataFrame) -> DataFrame:
    """Pearson r of ln peak and ln total (null under three n) and the mean of total / peak."""
    return per_n.agg(F.count("*").alias("n_count"), F.when(F.count("*") >= 3, F.corr(F.ln("peak"), F.ln("total"))).alias("r"), F.avg(F.col("total") / F.col("peak")).alias("total_per_peak"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > t) of Student's distribution, by the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a if x else 0.0
    return 1 - front * _beta_fraction(b, a, 1 - x) / b if x < 1 else 1.0


def correlations(df: DataFrame, columns: list[str], target: str) -> list[tuple[str, float, float]]:
    """(column, r, p) by one aggregation."""
    row = df.agg(F.count(target).alias("n"), *[F.corr(F.col(c).cast("double"), target).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        r = row[c]
        if r is None or math.isnan(r):
            out.append((c, math.nan, math.nan))
            continue
        df_ = row["n"] - 2
        t = r * math.sqrt(df_ / max(1e-300, 1 - r * r))
        out.append((c, r, t_two_sided(abs(t), df_)))
    return out


def least_squares(df: DataFrame, columns: list[str], target: str, intercept: bool = True) -> dict:
    """Ordinary least squares by normal equations: one aggregation of all products, solved on the driver."""
    x = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in columns]
    y = F.col(target).cast("double")
    whole = df.where(" and ".join(f"`{c}` is not null" for c in [*columns, target]))
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * y).alias(f"y{i}") for i in range(k)]
    row = whole.agg(F.count("*").alias("n"), F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), *sums).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"x{i}_{j}"]
    b = np.array([row[f"y{i}"] for i in range(k)])
    coef, *_ = np.linalg.lstsq(a, b, rcond=None)
    n, rss = row["n"], max(0.0, row["yy"] - coef @ b)
    tss = row["yy"] - (row["sy"] ** 2 / row["n"] if intercept else 0.0)
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(a)) * rss / max(1, n - k)))
    t = np.divide(coef, se, out=np.full(k, np.inf), where=se > 0)
    return {"features": (["intercept"] if intercept else []) + list(columns), "coef": coef.tolist(), "se": se.tolist(), "t": t.tolist(), "p": [t_two_sided(abs(v), n - k) for v in t], "r2": 1 - rss / tss if tss else math.nan, "rmse": math.sqrt(rss / n), "n_obs": n}


def errors(actual: Column, predicted: Column) -> list[Column]:
    """R², RMSE, MAE and n as aggregates."""
    d = actual - predicted
    return [(1 - F.avg(d * d) / F.var_pop(actual)).alias("r2"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(d).alias("n")]


def worst(df: DataFrame, actual: str, predicted: str, k: int = 8) -> DataFrame:
    return df.withColumn("err", F.col(predicted) - F.col(actual)).orderBy(F.abs("err").desc()).limit(k)


def log_sum_exp(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """ln(sum(exp(value))) by key, scaled by the largest: two aggregates, both combined before they are shuffled.

    A partial sum is kept for each stretch of 64 that values fall into, so no row has to know its key's largest value;
    the few partial sums of a key are then brought to its highest stretch. Nulls are left out; a key of nulls has null.
    """
    step = F.floor(F.col(value) / 64)
    parts = df.groupBy(*keys, step.alias("_step")).agg(F.sum(F.exp(F.col(value) - 64 * step)).alias("_sum"))
    top = parts.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.max("_step").alias("_top"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], F.lit(True))
    scaled = F.sum(F.col("_sum") * F.exp(64.0 * (F.col("_step") - F.col("_top"))))
    return parts.join(top, same).groupBy(*keys).agg((64 * F.max("_top") + F.ln(scaled)).alias("lse"))


def overrun_penalty(df: DataFrame, value: str, safe: float, *keys: str, weight: float = 20.0) -> DataFrame:
    """Sum of weight * (value - safe)² above ``safe``."""
    return df.groupBy(*keys).agg(F.sum(weight * F.pow(F.greatest(F.col(value) - safe, F.lit(0.0)), 2)).alias("penalty"))


def standardise(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean over their population deviation (1 where that is below 1e-9)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scale = {c: (row[f"m_{c}"] or 0.0, s if (s := row[f"s_{c}"] or 0.0) >= 1e-9 else 1.0) for c in columns}
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}), scale


def convolve(df: DataFrame, value: str, kernel: list[float], order: str, *keys: str) -> DataFrame:
    """``conv``: a centred convolution along ``order``, zero beyond the ends."""
    over, half = Window.partitionBy(*keys).orderBy(order), len(kernel) // 2
    terms = [w * F.coalesce(F.lag(value, half - i).over(over) if i < half else F.lead(value, i - half).over(over) if i > half else F.col(value), F.lit(0.0)) for i, w in enumerate(kernel)]
    return df.withColumn("conv", sum(terms[1:], terms[0]))


def best_model(models: DataFrame) -> DataFrame:
    """The name of largest held-out R²; a training R² alone counts 0.15 less."""
    return models.agg(F.max_by("name", F.coalesce("loo_r2", F.col("r2") - 0.15)).alias("name"))
