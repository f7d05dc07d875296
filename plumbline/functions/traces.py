"""Features of clock traces and of formula assignments, one Arrow kernel a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the features, in order; and the rating bands' lower ends.
CLOCK_FEATURES = [
    "base", "inc", "n", "mean", "sd", "median", "p10", "p25", "p75", "p90", "max", "first", "second", "third", "under_1", "under_half", "over_10",
    "early", "late", "late_less_early", "trend", "ac1", "total", "total_share", "left", "left_share", "step", "variation",
]
BANDS = [0, 1200, 1500, 1800, 2100]
SAT_FEATURES = [
    "positive", "mean", "sd", "true_0", "true_1", "true_2", "true_3", "true_mean", "true_sd", "true_min", "true_max", "agree", "agree_top", "agree_bottom",
    "corr_degree", "corr_bias", "critical", "critical_max", "critical_mean", "degree_pos", "degree_neg", "bias_pos", "bias_neg", "unused", "degree_p90", "degree_p10", "balance", "bias_abs",
]


def band(rating: Column) -> Column:
    """The rating's band; below the first or from the last on, the last."""
    out = F.lit(len(BANDS) - 1)
    for i, (low, high) in reversed(list(enumerate(zip(BANDS, BANDS[1:], strict=False)))):
        out = F.when((rating >= low) & (rating < high), i).otherwise(out)
    return out


def used_times(secs: np.ndarray, base: int, inc: int) -> np.ndarray:
    """Time used between marks, never negative nor above what the control allows."""
    used = np.maximum(0.0, secs[:-1] + inc - secs[1:])
    return np.clip(used, 0, base + inc * len(used))


def clock_vector(secs: np.ndarray, base: int, inc: int) -> list[float] | None:
    if len(secs) < 8:
        return None
    u = used_times(secs, base, inc)
    n, k = len(u), max(1, len(u) // 3)
    steady = u.std() == 0
    x = np.arange(n) - (n - 1) / 2
    mean_step = float(np.abs(np.diff(u)).mean())
    q = np.percentile(u, [50, 10, 25, 75, 90])
    flat = steady or u[:-1].std() == 0 or u[1:].std() == 0
    ac1 = 0.0 if flat else float(np.corrcoef(u[:-1], u[1:])[0, 1])
    early, late, whole = u[:k].mean(), u[-k:].mean(), max(base, 1)
    out = [base, inc, n, u.mean(), u.std(), *q, u.max(), *u[:3], (u < 1).mean(), (u < 0.5).mean(), (u > 10).mean(), early, late, late - early]
    out += [0.0 if steady else (x * u).sum() / (x * x).sum(), ac1, u.sum(), u.sum() / whole, secs[-1], secs[-1] / whole, mean_step, u.std() / (u.mean() + 1e-9)]
    return [float(v) for v in out]


def clock_features(secs: str, base: str, inc: str) -> Column:
    @F.pandas_udf("array<double>")
    def f(s: pd.Series, b: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else clock_vector(np.asarray(x, float), int(y), int(z)) for x, y, z in zip(s, b, i, strict=True)])

    return f(F.col(secs), F.col(base), F.col(inc))


def safe_corr(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0


def sat_vector(clauses: list, sign: np.ndarray) -> list[float]:
    """Joint features of a formula (lists of non-zero literals) and an assignment of -1 or 1."""
    n, a = len(sign), sign.astype(float)
    of = np.repeat(np.arange(len(clauses)), [len(c) for c in clauses])
    lit = np.concatenate([np.asarray(c, np.int64) for c in clauses])
    var, positive = np.abs(lit) - 1, lit > 0
    pos, neg = np.bincount(var[positive], minlength=n), np.bincount(var[~positive], minlength=n)
    degree, bias = pos + neg, pos - neg
    true = np.bincount(of[(a[var] > 0) == positive], minlength=len(clauses))
    follows = np.sign(bias) == a
    k = max(1, n // 10)
    top, bottom = np.argsort(-degree, kind="stable")[:k], np.argsort(degree, kind="stable")[:k]
    critical = np.bincount(var[true[of] == 1], minlength=n)
    mean = lambda x, m: float(x[m].mean()) if m.any() else 0.0
    yes, no = a > 0, a < 0
    return [
        yes.mean(), a.mean(), a.std(), *[(true == j).mean() for j in range(4)], true.mean(), true.std(), true.min(), true.max(), follows.mean(), follows[top].mean(), follows[bottom].mean(),
        safe_corr(degree, a), safe_corr(bias, a), critical.sum() / n, critical.max(), mean(a, critical > 0), mean(degree, yes), mean(degree, no), mean(bias, yes), mean(bias, no),
        (degree == 0).mean(), *np.percentile(degree, [90, 10]), (yes.sum() - no.sum()) / n, np.abs(bias).mean(),
    ]


def sat_features(clauses: str, sign: str) -> Column:
    @F.pandas_udf("array<double>")
    def f(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in sat_vector(list(x), np.asarray(y))] for x, y in zip(c, s, strict=True)])

    return f(F.col(clauses), F.col(sign))
