"""Numerical kernels in numpy for what has no closed form in DataFrame functions.

They work on the arrays of one series and are called from grouped functions, so that series run in parallel.
"""

from __future__ import annotations

import math

import numpy as np

# ---------------------------------------------------------------- probabilities


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, evaluated from the back."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, u = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tail = np.ones_like(u)
    for m in range(200, 0, -1):
        even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m - 1) * (p + q + m - 1) * u / ((p + 2 * m - 2) * (p + 2 * m - 1))
        tail = 1 + odd / (1 + even / tail)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(u) + q * np.log1p(-u)) / p
    part = np.where(u <= 0, 0.0, np.where(u >= 1, 1.0, front / tail))
    return np.where(swap, 1 - part, part)


def p_of_r(r, n) -> np.ndarray:
    """Two-sided p of a correlation over an (effective) number of points; NaN without freedom or at abs(r) = 1."""
    r, df = np.asarray(r, float), np.asarray(n, float) - 2
    ok = (df > 0) & (np.abs(r) < 1)
    return np.where(ok, beta_fraction(np.where(ok, df, 1) / 2, 0.5, np.where(ok, 1 - r * r, 0.5)), np.nan)


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson r of the rows of two arrays; 0 where a row doesn't vary."""
    x, y = x - x.mean(-1, keepdims=True), y - y.mean(-1, keepdims=True)
    size = np.sqrt((x * x).sum(-1) * (y * y).sum(-1))
    return np.where(size > 0, (x * y).sum(-1) / np.where(size > 0, size, 1), 0.0)


# ---------------------------------------------------------------- resampling


def blocks_of(n: int) -> int:
    if n < 4:
        return max(1, n // 2)
    return int(min(max(round(n ** (1 / 3)), 2), max(2, n // 2)))


def bootstrap_interval(x: np.ndarray, y: np.ndarray, block: int, draws: int, seed: int, alpha: float = 0.05) -> tuple[float, float]:
    """Interval of r under resampling of blocks that may start anywhere. The stream of draws is fixed by the seed."""
    n = len(x)
    if n < 2 * block or x.std() == 0 or y.std() == 0:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    per_draw = -(-n // block)
    begins = np.stack([rng.integers(0, n - block + 1, size=per_draw) for _ in range(draws)])
    pick = (begins[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]
    r = np.concatenate([correlation(x[p], y[p]) for p in np.array_split(pick, max(1, draws * n // 400_000))])
    return tuple(float(v) for v in np.quantile(r, [alpha / 2, 1 - alpha / 2]))


def permutation_p(x: np.ndarray, y: np.ndarray, block: int, draws: int, seed: int) -> float:
    """Share of reorderings of x by whole blocks that correlate with y at least as strongly, never 0."""
    n = len(x)
    if n < 2 * block or x.std() == 0 or y.std() == 0:
        return math.nan
    # blocks as rows of places, the last one filled up with n, which is taken out again after the reordering
    rng, count = np.random.default_rng(seed), -(-n // block)
    places = np.minimum(np.arange(count * block), n).reshape(count, block)
    centred = y - y.mean()
    observed, strong = abs(float((x - x.mean()) @ centred)), 0
    for some in np.array_split(np.arange(draws), max(1, draws * n // 400_000)):
        order = np.stack([rng.permutation(count) for _ in some])
        mixed = places[order].reshape(len(some), -1)
        # a reordering changes neither mean nor spread of x, so sums of products rank as correlations do
        strong += int((np.abs(x[mixed[mixed < n].reshape(len(some), n)] @ centred) >= observed * (1 - 1e-12)).sum())
    return (strong + 1) / (draws + 1)


def mean_interval(x: np.ndarray, draws: int = 2000, seed: int = 12345, alpha: float = 0.05) -> tuple[float, float]:
    """Interval of a mean under independent resampling."""
    x = x[~np.isnan(x)]
    if len(x) < 2:
        return math.nan, math.nan
    means = np.random.default_rng(seed).choice(x, size=(draws, len(x)), replace=True).mean(axis=1)
    return tuple(float(v) for v in np.quantile(means, [alpha / 2, 1 - alpha / 2]))


# ---------------------------------------------------------------- dependence


def autocorrelations(x: np.ndarray, most: int) -> np.ndarray:
    """At lags 1 to `most`, about the mean of the whole; 0 where x doesn't vary or isn't long enough."""
    d, out = x - x.mean(), np.zeros(most)
    full = np.correlate(d, d, "full")[len(d) :][:most]
    total = float(d @ d)
    if total > 0:
        out[: len(full)] = full / total
    return out


def pairs_worth(x: np.ndarray, y: np.ndarray, width: int | None = None) -> float:
    """Number of independent pairs that n dependent ones are worth.

    The variance of r grows with the products of the autocorrelations of x and y. Without a width they fall off as
    powers of the product at lag 1, whose sum is known; with one they are summed under a Bartlett window of it.
    """
    n = len(x)
    if width is None:
        ab = float(autocorrelations(x, 1)[0] * autocorrelations(y, 1)[0])
        inflation = (1 + ab) / (1 - ab)
    else:
        window = 1 - np.arange(1, width + 1) / (width + 1)
        inflation = 1 + 2 * float(window @ (autocorrelations(x, width) * autocorrelations(y, width)))
    return float(np.clip(n / inflation, 2.0, n)) if inflation > 0 else 2.0


def bartlett_width(n: int) -> int:
    return max(1, min(int(4 * (n / 100) ** (2 / 9)), n - 2))


# ---------------------------------------------------------------- smoothing


def local_line(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Locally weighted straight lines (tricube over the `span` nearest of sorted x), evaluated at `at`."""
    n = len(x)
    k = min(max(2, span), n)
    left = np.clip(np.searchsorted(x, at) - k, 0, n - k)
    for _ in range(k):  # move the window right while its left end is farther than the point after its right end
        more = (left + k < n) & (at - x[left] > x[np.minimum(left + k, n - 1)] - at)
        if not more.any():
            break
        left = left + more
    near = left[:, None] + np.arange(k)
    d = x[near] - at[:, None]
    reach = np.abs(d).max(axis=1, keepdims=True) * (span / k if span > n else 1)
    reach = np.where(reach > 0, reach, 1)
    w = (1 - np.minimum(np.abs(d) / (reach * 1.0000001), 1) ** 3) ** 3
    if weight is not None:
        w = w * weight[near]
    w = np.where(w.sum(axis=1, keepdims=True) > 0, w, 1)
    total = w.sum(axis=1)
    mx, my = (w * d).sum(axis=1) / total, (w * y[near]).sum(axis=1) / total
    dx = d - mx[:, None]
    var = (w * dx * dx).sum(axis=1)
    slope = np.where(var > 1e-12 * total, (w * dx * (y[near] - my[:, None])).sum(axis=1) / np.where(var > 0, var, 1), 0.0)
    return my - slope * mx


def bisquare(residual: np.ndarray) -> np.ndarray:
    middle = 6 * np.median(np.abs(residual))
    return (1 - np.minimum(np.abs(residual) / middle, 1) ** 2) ** 2 if middle > 0 else np.ones_like(residual)


def lowess(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 3) -> np.ndarray:
    """Robust locally weighted regression at the points themselves."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    span, weight = int(share * len(x) + 1e-10), None
    for _ in range(rounds + 1):
        fit = local_line(xs, ys, xs, span, weight)
        weight = bisquare(ys - fit)
    out = np.empty_like(fit)
    out[order] = fit
    return out


def _odd(v: float) -> int:
    n = math.ceil(v)
    return n + 1 - n % 2


def seasonal_trend(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition by local regression: (seasonal, trend) of an even series without gaps."""
    n = len(y)
    t = np.arange(n, dtype=float)
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    trend, season, weight = np.zeros(n), np.zeros(n), np.ones(n)

    def running(v: np.ndarray, width: int) -> np.ndarray:
        s = np.concatenate([[0.0], np.cumsum(v)])
        return (s[width:] - s[:-width]) / width

    for _ in range(outer + 1):
        for _ in range(inner):
            rough = np.empty(n + 2 * period)
            for phase in range(period):
                own = np.arange(phase, n, period)
                x = np.arange(len(own), dtype=float)
                at = np.arange(-1.0, len(own) + 1)
                rough[phase :: period][: len(at)] = local_line(x, (y - trend)[own], at, seasonal, weight[own])
            low = running(running(running(rough, period), period), 3)
            season = rough[period : period + n] - local_line(t, low, t, low_span)
            trend = local_line(t, y - season, t, trend_span, weight)
        weight = bisquare(y - season - trend)
    return season, trend


# ---------------------------------------------------------------- trends


def spline_design(t: np.ndarray, df: int) -> np.ndarray:
    """Powers of t up to a cubic; beyond 4 degrees of freedom truncated cubics at even quantiles of [0, 1]."""
    knots = np.linspace(0, 1, max(df - 4, 0) + 2)[1:-1]
    return np.hstack([np.vander(t, min(max(df, 1), 4), increasing=True), np.clip(t[:, None] - knots, 0, None) ** 3])


def smooth(t: np.ndarray, y: np.ndarray, at: np.ndarray, df: float, estimator: str) -> np.ndarray:
    if estimator == "spline":
        return spline_design(at, int(df)) @ np.linalg.lstsq(spline_design(t, int(df)), y, rcond=None)[0]
    share = min(max(4 / max(df, 1.0), 0.12), 0.95)
    return np.interp(at, t, lowess(t, y, share))


def fold_error(t: np.ndarray, y: np.ndarray, df: float, estimator: str, folds: int) -> float:
    """Mean over contiguous folds of the squared error of each, predicted from the rest; inf if none can be."""
    edges = np.linspace(0, len(t), folds + 1).astype(int)
    errors = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rest = np.r_[0:a, b : len(t)]
        if b > a and len(rest) > int(df) + 1:
            errors.append(float(np.mean((y[a:b] - smooth(t[rest], y[rest], t[a:b], df, estimator)) ** 2)))
    return float(np.mean(errors)) if errors else math.inf


def generalised_error(t: np.ndarray, y: np.ndarray, df: float) -> float:
    rss = float(((y - smooth(t, y, t, df, "spline")) ** 2).sum())
    return len(y) * rss / (1 - df / len(y)) ** 2 if df < len(y) else math.inf


def harmonics(phase: np.ndarray, order: int) -> np.ndarray:
    return np.stack([np.ones_like(phase)] + [f(j * phase) for j in range(1, order + 1) for f in (np.cos, np.sin)], axis=1)


def residual_of(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


class AdditiveModel:
    """Piecewise-linear trend with yearly and weekly harmonics, fitted by penalised least squares.

    An approximation of the published additive forecasting model (Taylor and Letham, 2018): 25 possible changes of
    slope in the first four fifths of the history with a Laplace prior (solved as reweighted ridge), wide normal
    priors on the rest, and the most probable coefficients.
    """

    def __init__(self, days: np.ndarray, y: np.ndarray, yearly: int, weekly: int, change_prior: float, growth: str = "linear", changes: int = 25):
        self.first, self.span = float(days.min()), float(max(np.ptp(days), 1))
        self.yearly, self.weekly, self.growth = yearly, weekly, growth
        self.scale = float(np.abs(y).max()) or 1.0
        t = (days - self.first) / self.span
        n_changes = min(changes, max(0, int(len(t) * 0.8) - 1)) if growth == "linear" else 0
        at = np.linspace(0, int(len(t) * 0.8) - 1, n_changes + 1).round().astype(int)[1:]
        self.changes = np.sort(t)[at] if n_changes else np.zeros(0)
        design = np.concatenate(self._parts(days), axis=1)
        n_trend, n_season = design.shape[1] - 2 * yearly - 2 * weekly - len(self.changes), 2 * yearly + 2 * weekly
        delta = np.full(len(self.changes), change_prior)
        target, noise = y / self.scale, 0.1
        for _ in range(30):
            penalty = np.concatenate([np.full(n_trend, 1 / 25.0), 1 / (change_prior * np.maximum(np.abs(delta), 1e-4)), np.full(n_season, 1 / 100.0)])
            self.coef = np.linalg.solve(design.T @ design / noise**2 + np.diag(penalty), design.T @ target / noise**2)
            delta = self.coef[n_trend : n_trend + len(self.changes)]
            noise = max(float(np.std(target - design @ self.coef)), 1e-4)

    def _parts(self, days: np.ndarray) -> list[np.ndarray]:
        t = (days - self.first) / self.span
        trend = np.stack([np.ones_like(t)] + ([t] if self.growth == "linear" else []), axis=1)
        bends = np.maximum(t[:, None] - self.changes, 0)
        year, week = (harmonics(2 * np.pi * days / p, k)[:, 1:] if k else np.zeros((len(t), 0)) for p, k in ((365.25, self.yearly), (7.0, self.weekly)))
        return [trend, bends, year, week]

    def predict(self, days: np.ndarray) -> dict[str, np.ndarray]:
        parts, out, i = self._parts(days), [], 0
        for p in parts:
            out.append(p @ self.coef[i : i + p.shape[1]] * self.scale)
            i += p.shape[1]
        return {"trend": out[0] + out[1], "yearly": out[2], "weekly": out[3]}
