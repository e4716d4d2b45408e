"""Distribution functions in NumPy, for use inside Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


def norm_ppf(p: float) -> float:
    """Newton steps on the normal distribution function, from a logistic start."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = math.log(p / (1 - p)) / 1.702
    for _ in range(60):
        step = (0.5 * math.erfc(-x / math.sqrt(2)) - p) / max(math.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300)
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-13:
            break
    return x


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * beta_inc(nu / 2, 0.5, nu / (nu + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, nu: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, nu) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square with 1 or an even number of degrees of freedom."""
    if k == 1:
        return math.erfc(math.sqrt(max(x, 0) / 2))
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def ks_uniform(u) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance of a sample from the uniform law, with its asymptotic p-value."""
    u = np.sort(np.asarray(u, float))
    n = len(u)
    if not n:
        return 0.0, 1.0
    d = float(max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max()))
    z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return d, float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))) if z > 0.2 else 1.0


def minimise(f, x0, step: float = 0.1, rounds: int = 400, tol: float = 1e-10) -> np.ndarray:
    """Downhill simplex search."""
    n = len(x0)
    pts = [np.array(x0, float)] + [np.array(x0, float) + step * (abs(x0[i]) + 0.1) * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol * (abs(val[0]) + tol):
            break
        mid = np.mean(pts[:-1], axis=0)
        mirrored = 2 * mid - pts[-1]
        fm = f(mirrored)
        if fm < val[0]:
            far = 3 * mid - 2 * pts[-1]
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fm else (mirrored, fm)
        elif fm < val[-2]:
            pts[-1], val[-1] = mirrored, fm
        else:
            near = (mid + (mirrored if fm < val[-1] else pts[-1])) / 2
            fn = f(near)
            if fn < min(fm, val[-1]):
                pts[-1], val[-1] = near, fn
            else:
                pts = [pts[0]] + [(p + pts[0]) / 2 for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]
