"""Regressions over panels from cross-product sums: rows are only ever summed, and what is solved are small matrices, one row of sums each."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evidence import rank_ic


def moments(columns: list[Column]) -> Column:
    """Sums of all products of two of the columns and 1, as one array: the upper triangle row by row."""
    cols = [F.lit(1.0), *columns]
    return F.array(*[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]])


def square(flat: np.ndarray, k: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle of ``k`` columns and 1."""
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = flat
    return m + np.triu(m, 1).T


def standardized(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """From sums over 1, features and target: cross products of the standardised features, with the target, means, scales and the target's mean."""
    n, mean = m[0, 0], m[0, 1:-1] / m[0, 0]
    centred = m[1:-1, 1:-1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred), 0) / n)
    scale[scale <= 1e-12] = 1.0
    target = m[0, -1] / n
    return centred / np.outer(scale, scale), (m[1:-1, -1] - n * mean * target) / scale, mean, scale, target


def elastic_net(gram: np.ndarray, cross: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Coordinate descent on cross products of standardised features; without an l1 part the ridge solution."""
    if l1_ratio <= 0:
        return np.linalg.pinv(gram + alpha * np.eye(len(gram)), hermitian=True) @ cross
    b = np.zeros(len(gram))
    for _ in range(rounds):
        before = b.copy()
        for j in range(len(b)):
            raw = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(raw) * max(abs(raw) - alpha * l1_ratio, 0.0) / max(gram[j, j] + alpha * (1.0 - l1_ratio), 1e-15)
        if np.abs(b - before).max() < tolerance:
            break
    return b


def walk_forward(panel: DataFrame, features: list[str], label: str, period: str, group: str, least: int = 12, alphas: tuple[float, ...] = (0.01, 0.1, 1.0), ratios: tuple[float, ...] = (0.0, 0.5)) -> DataFrame:
    """Elastic-net predictions of each period from earlier ones: ``panel`` with prediction, actual, alpha and l1_ratio.

    The target is the label less its mean over the period's group; missing features count as 0. From ``least`` earlier periods on, the last fifth of them
    (three at least) chooses penalty and mix among models of the periods before; the chosen ones are fitted to all earlier periods. Errors on the
    tail follow from sums too, so rows are read once, however many models are tried. Sums are carried over one row per period.
    """
    k = len(features)
    x = panel.where(F.col(label).isNotNull()).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    x = x.withColumn("actual", F.col(label) - F.avg(label).over(Window.partitionBy(period, group)))
    size = (k + 2) * (k + 3) // 2
    per = x.groupBy(period).agg(moments([F.col(c) for c in [*features, "actual"]]).alias("m"))
    order = Window.orderBy(period)
    sums = per.select(period, (F.row_number().over(order) - 1).alias("i"), F.array(*[F.sum(F.col("m")[j]).over(order) for j in range(size)]).alias("upto"))
    tail = F.greatest(F.lit(3), F.floor(F.col("i") / 5).cast("int"))
    fits = sums.where(F.col("i") >= least).select(period, (F.col("i") - 1).alias("__all"), (F.col("i") - 1 - tail).alias("__inner"))
    at = lambda name: sums.select(F.col("i").alias(f"__{name}"), F.col("upto").alias(name))
    fits = fits.join(at("all"), "__all").join(at("inner"), "__inner").select(period, "all", "inner")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for when, whole, first in zip(pdf[period], pdf["all"], pdf["inner"], strict=True):
                whole, first = square(np.array(whole), k + 1), square(np.array(first), k + 1)
                last = whole - first
                best = None
                for alpha in alphas:
                    for ratio in ratios:
                        gram, cross, mean, scale, target = standardized(first)
                        w = elastic_net(gram, cross, alpha, ratio) / scale
                        c = np.array([target - w @ mean, *w, -1.0])  # prediction less target
                        best = min(best or (np.inf,), (float(c @ last @ c) / last[0, 0], alpha, ratio))
                gram, cross, mean, scale, target = standardized(whole)
                w = elastic_net(gram, cross, best[1], best[2]) / scale
                rows.append((when, best[1], best[2], [float(target - w @ mean), *w.tolist()]))
            yield pd.DataFrame(rows, columns=[period, "alpha", "l1_ratio", "w"])

    kind = panel.schema[period].dataType.simpleString()
    models = fits.mapInPandas(solve, f"{period} {kind}, alpha double, l1_ratio double, w array<double>")
    value = F.col("w")[0]
    for j, f in enumerate(features):
        value = value + F.col("w")[j + 1] * F.col(f)
    return x.join(models, period).withColumn("prediction", value).drop("w")


def redundancy(panel: DataFrame, factors: list[str], fwd: str = "fwd") -> DataFrame:
    """month, factor, vif, mean_corr, marginal_ic and conditional_ic of each factor in each month.

    mean_corr is the mean of its correlations with the others, each over the names that have both. marginal_ic is its rank correlation with the
    forward return, over five names at least. For vif and conditional_ic a month's factors are those with ten values and returns, and its names
    those with all of them and a return, three more than factors at least: each factor is regressed on the others, and what is left is ranked
    against the return. The regressions come from sums; a row only takes its residuals.
    """
    k = len(factors)
    others = lambda i: [F.corr(factors[i], factors[j]) for j in range(k) if j != i]
    mean = lambda cs: F.aggregate(F.filter(F.array(*cs), lambda c: c.isNotNull() & ~F.isnan(c)), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, c: F.struct((a["s"] + c).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
    corr = panel.groupBy("month").agg(F.array(*[mean(others(i)) for i in range(k)]).alias("corr"), F.array(*[F.count(F.when(F.col(fwd).isNotNull(), F.col(f))) >= 10 for f in factors]).alias("has"))
    x = panel.where(F.col(fwd).isNotNull()).join(corr.select("month", "has"), "month")
    for i, f in enumerate(factors):
        x = x.where(~F.col("has")[i] | F.col(f).isNotNull())
    filled = x.withColumns({f: F.when(F.col("has")[i], F.col(f).cast("double")).otherwise(0.0) for i, f in enumerate(factors)})
    sums = filled.groupBy("month", "has").agg(moments([F.col(f) for f in factors]).alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for month, has, flat in zip(pdf["month"], pdf["has"], pdf["m"], strict=True):
                m, on = square(np.array(flat), k), np.flatnonzero(has)
                n, p = m[0, 0], len(on)
                if p < 2 or n < p + 3:
                    continue
                mean = m[0, 1:][on] / n
                cov = m[1:, 1:][np.ix_(on, on)] / n - np.outer(mean, mean)
                scale = np.sqrt(np.maximum(np.diag(cov), 0))
                flatness = scale <= 1e-15
                scale[flatness] = 1.0
                r = cov / np.outer(scale, scale)
                vifs, parts = [None] * k, [None] * k
                for a, i in enumerate(on):
                    rest = np.delete(np.arange(p), a)
                    b = np.linalg.pinv(r[np.ix_(rest, rest)], hermitian=True) @ r[rest, a]
                    vifs[i] = 1.0 / max(1.0 - min(0.0 if flatness[a] else float(b @ r[rest, a]), 0.999999), 1e-6)
                    left = np.zeros(k + 1)
                    left[1 + on[a]] = 1 / scale[a]
                    left[1 + on[rest]] = -b / scale[rest]
                    left[0] = -left[1 + on] @ mean
                    parts[i] = left.tolist()
                rows.append((month, vifs, parts))
            yield pd.DataFrame(rows, columns=["month", "vif", "left"])

    solved = sums.mapInPandas(solve, f"month {panel.schema['month'].dataType.simpleString()}, vif array<double>, left array<array<double>>")
    names = F.array(*[F.lit(f) for f in factors])
    values = [F.lit(1.0), *[F.col(f) for f in factors]]
    residual = lambda i: sum((F.col("left")[i][j] * values[j] for j in range(1, k + 1)), F.col("left")[i][0])
    keyed = F.struct("month", "factor").alias("month")

    def ics(df: DataFrame, scores: list[Column], name: str) -> DataFrame:
        one = df.select("month", fwd, F.explode(F.arrays_zip(names.alias("factor"), F.array(*scores).alias("score"))).alias("s")).select("month", "s.factor", "s.score", F.col(fwd).alias("fwd"))
        got = rank_ic(one.select(keyed, "score", "fwd"))
        return got.select("month.*", F.col("ic").alias(name))

    marginal = ics(panel, [F.col(f).cast("double") for f in factors], "marginal_ic")
    conditional = ics(filled.join(solved.select("month", "left"), "month"), [residual(i) for i in range(k)], "conditional_ic")
    out = corr.join(solved, "month", "left").select("month", F.explode(F.arrays_zip(names.alias("factor"), F.coalesce("vif", F.transform(names, lambda _: F.lit(None).cast("double"))).alias("vif"), F.col("corr"))).alias("s"))
    out = out.select("month", "s.factor", "s.vif", F.col("s.corr").alias("mean_corr"))
    return out.join(marginal, ["month", "factor"], "left").join(conditional, ["month", "factor"], "left")


def alpha_evidence(df: DataFrame, by: str, day: str, ret: str, market: str, styles: list[str], samples: int = 400, seed: str = "s", least_ratio: float = 0.3) -> DataFrame:
    """Evidence of each strategy's alpha over its market and styles: n, active_mean, ir, active_t, alpha, betas (market first), alpha_se, alpha_t, 95 % intervals of
    active mean and alpha, and passed.

    Standard errors allow for heteroscedasticity and autocorrelation (Bartlett weights up to lag max(1, int(n^0.25))). A coefficient's variance needs
    only one number per row, its influence, so lagged products are sums over one series. Bootstrap samples are circular blocks of int(sqrt(n)) days
    whose sums are differences of running sums; their starts come from digests of (seed, sample, block), the same for all strategies. One task has
    the rows of a strategy, one per day, so that neither lags nor samples are rows of a table. Rows with a missing value are left out, and
    strategies with fewer than 20 rows.
    """
    factors = [market, *styles]
    k = len(factors)
    x = df.dropna(subset=[by, *factors, ret]).select(by, day, *[F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate([*factors, ret])])
    low, high = int(0.025 * (samples - 1)), int(0.975 * (samples - 1))
    upper = np.triu_indices(k + 2)
    digests: dict[int, np.ndarray] = {}

    def evidence(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if n < 20:
            return pd.DataFrame()
        pdf = pdf.sort_values(day, kind="stable")
        design = np.column_stack([np.ones(n), *[pdf[f"__x{j}"].to_numpy(float) for j in range(k + 1)]])
        products = design[:, upper[0]] * design[:, upper[1]]
        m = square(products.sum(axis=0), k + 1)
        inverse = np.linalg.pinv(m[:-1, :-1], hermitian=True)
        b = inverse @ m[:-1, -1]
        active = design[:, -1] - design[:, 1]
        mean = active.mean()
        lags = max(1, int(n**0.25))

        def spread(v: np.ndarray) -> float:
            return float(v @ v + sum(2 * (1 - lag / (lags + 1)) * (v[lag:] @ v[:-lag]) for lag in range(1, lags + 1)))

        variance, noise = spread((design[:, :-1] @ inverse[0]) * (design[:, -1] - design[:, :-1] @ b)), spread(active - mean)
        block = math.isqrt(n)
        blocks = -(-n // block)
        if blocks not in digests:
            digests[blocks] = np.array([[int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[:8], 16) for j in range(blocks)] for i in range(samples)], dtype=np.int64)
        start = digests[blocks] % n
        end = start + np.minimum(block, n - block * np.arange(blocks))
        running = np.concatenate([np.zeros((1, products.shape[1])), np.cumsum(np.concatenate([products, products[:block]]), axis=0)])
        # Block by block, so that no more than a sum per sample is held.
        total = sum(running[end[:, j]] - running[start[:, j]] for j in range(blocks))
        drawn = np.zeros((samples, k + 2, k + 2))
        drawn[:, upper[0], upper[1]] = drawn[:, upper[1], upper[0]] = total
        alphas = np.sort((np.linalg.pinv(drawn[:, :-1, :-1], hermitian=True) @ drawn[:, :-1, -1:])[:, 0, 0])
        actives = np.sort((drawn[:, 0, -1] - drawn[:, 0, 1]) / drawn[:, 0, 0])
        return pd.DataFrame([(pdf[by].iloc[0], n, mean, active.std(ddof=1), b.tolist(), variance, noise, actives[low], actives[high], alphas[low], alphas[high])], columns=[by, "n", "active_mean", "__sd", "b", "__vg", "__vd", *told])

    told = ["active_low", "active_high", "alpha_low", "alpha_high"]
    schema = f"{by} {df.schema[by].dataType.simpleString()}, n long, active_mean double, __sd double, b array<double>, __vg double, __vd double, {', '.join(f'{c} double' for c in told)}"
    out = x.groupBy(by).applyInPandas(evidence, schema)
    se = F.sqrt(F.greatest("__vg", F.lit(0.0)))
    ir = F.when(F.col("__sd") > 0, F.col("active_mean") / F.col("__sd") * F.sqrt(F.lit(252.0)))
    passed = (F.col("active_low") > 0) & (F.col("alpha_low") > 0) & F.coalesce(ir >= least_ratio, F.lit(False))
    active_se = F.sqrt(F.col("__vd")) / F.col("n")
    return out.select(
        by, "n", "active_mean", ir.alias("ir"), F.when(active_se > 0, F.col("active_mean") / active_se).alias("active_t"), F.col("b")[0].alias("alpha"), F.slice("b", 2, k).alias("betas"), se.alias("alpha_se"),
        F.when(se > 0, F.col("b")[0] / se).alias("alpha_t"), *told, passed.alias("passed"),
    )


def weight_grid(weights: dict[str, float], step: float = 0.05) -> list[dict[str, float]]:
    """The weights, and each of them moved down and up by a step (zero at least); all add up to one."""
    grid = [dict(weights)] + [{**weights, k: max(w + move, 0.0)} for k, w in weights.items() for move in (-step, step)]
    return [{k: w / sum(g.values()) for k, w in g.items()} for g in grid if sum(g.values()) > 0]


def perturbed(panel: DataFrame, weights: dict[str, float], fwd: str = "fwd", step: float = 0.05) -> DataFrame:
    """How the mean monthly correlation of a composite with forward returns stands among those of composites with one weight moved: center, share (below, ties
    half), low and high (without one smallest and one largest) and points. All composites are scored in one pass over the panel; a missing factor
    counts as 0."""
    grid = weight_grid(weights, step)
    score = lambda g: sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in g.items()), F.lit(0.0))
    per = panel.where(F.col(fwd).isNotNull()).groupBy("month").agg(*[F.corr(score(g), fwd).alias(f"v{i}") for i, g in enumerate(grid)])
    mean = per.select(F.array(*[F.avg(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))) for i in range(len(grid))]).alias("v"))
    center, n = F.col("v")[0], len(grid)
    below, ties = (F.size(F.filter("v", cond)) for cond in (lambda v: v < center, lambda v: v == center))
    ordered = F.sort_array("v")
    low, high = (1, n - 2) if n >= 3 else (0, n - 1)
    return mean.select(center.alias("center"), ((below + (ties - 1) / 2) / n).alias("share"), ordered[low].alias("low"), ordered[high].alias("high"), F.lit(n).alias("points"))
