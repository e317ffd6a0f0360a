"""Special functions missing from Spark SQL and numpy, vectorized, for use inside tasks or on a few numbers."""

from __future__ import annotations

import math

import numpy as np

# fixed values: Stirling series coefficients B_2k / (2k (2k - 1))
STIRLING = (1.0 / 12.0, -1.0 / 360.0, 1.0 / 1260.0, -1.0 / 1680.0, 1.0 / 1188.0)


def lgamma(z) -> np.ndarray:
    """log Gamma for positive arguments: shift by 8, then the Stirling series."""
    z = np.asarray(z, dtype=float)
    shift = np.ones_like(z)
    for k in range(8):
        shift = shift * (z + k)
    y = z + 8.0
    inv, inv2 = 1.0 / y, 1.0 / (y * y)
    tail = np.zeros_like(z)
    for c in reversed(STIRLING):
        tail = tail * inv2 + c
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2.0 * math.pi) + tail * inv - np.log(shift)


def lrising(z, k) -> np.ndarray:
    """log of Gamma(z + k) / Gamma(z) for k >= 0 without the cancellation of two large log-gammas."""
    z, k = np.broadcast_arrays(np.asarray(z, dtype=float), np.asarray(k, dtype=float))
    big = z > 64.0
    safe = np.where(big, z, 65.0)
    tail = np.zeros_like(safe)
    for j, c in enumerate(STIRLING):
        tail = tail + c * ((safe + k) ** -(2 * j + 1.0) - safe ** -(2 * j + 1.0))
    far = (safe + k - 0.5) * np.log1p(k / safe) + k * np.log(safe) - k + tail
    small = np.where(big, 1.0, z)
    return np.where(big, far, lgamma(small + k) - lgamma(small))


# fixed values: B_2k / (2k), coefficients of the digamma series, and B_2k, those of the trigamma series
DIGAMMA = (1.0 / 12.0, -1.0 / 120.0, 1.0 / 252.0, -1.0 / 240.0, 1.0 / 132.0, -691.0 / 32760.0)
TRIGAMMA = (1.0 / 6.0, -1.0 / 30.0, 1.0 / 42.0, -1.0 / 30.0, 5.0 / 66.0, -691.0 / 2730.0)


def digamma(z) -> np.ndarray:
    """Derivative of log Gamma for positive arguments: shift by 10, then the asymptotic series."""
    z = np.asarray(z, dtype=float)
    shift = np.zeros_like(z)
    for k in range(10):
        shift = shift + 1.0 / (z + k)
    y = z + 10.0
    inv2, tail = 1.0 / (y * y), np.zeros_like(z)
    for c in reversed(DIGAMMA):
        tail = (tail + c) * inv2
    return np.log(y) - 0.5 / y - tail - shift


def trigamma(z) -> np.ndarray:
    """Second derivative of log Gamma for positive arguments."""
    z = np.asarray(z, dtype=float)
    shift = np.zeros_like(z)
    for k in range(10):
        shift = shift + 1.0 / ((z + k) * (z + k))
    y = z + 10.0
    inv2, tail = 1.0 / (y * y), np.zeros_like(z)
    for c in reversed(TRIGAMMA):
        tail = (tail + c) * inv2
    return 1.0 / y + 0.5 * inv2 + tail / y + shift


def rising_derivatives(z, k) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of ``lrising`` in z, exact also where z is large and both gammas nearly agree."""
    z, k = np.broadcast_arrays(np.asarray(z, dtype=float), np.asarray(k, dtype=float))
    big = z > 64.0
    safe, small = np.where(big, z, 65.0), np.where(big, 1.0, z)
    y = safe + k
    one = np.log1p(k / safe) + 0.5 * k / (safe * y)
    two = -k / (safe * y) + 0.5 * (y ** -2.0 - safe ** -2.0)
    for j, (c, d) in enumerate(zip(DIGAMMA, TRIGAMMA)):
        one = one - c * (y ** -(2.0 * j + 2.0) - safe ** -(2.0 * j + 2.0))
        two = two + d * (y ** -(2.0 * j + 3.0) - safe ** -(2.0 * j + 3.0))
    return np.where(big, one, digamma(small + k) - digamma(small)), np.where(big, two, trigamma(small + k) - trigamma(small))


def lbeta(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a, dtype=float) + b)


def unit_gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(n)
    return 0.5 * (x + 1.0), 0.5 * w


def beta_nodes(a: float, b: float, n: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Jacobi rule for the mean over a Beta(a, b) variable: eigenvalues of the recurrence matrix of its orthogonal polynomials."""
    p, q = b - 1.0, a - 1.0
    k = np.arange(1.0, n)
    diagonal = np.r_[(a - b) / (a + b), (q - p) * (q + p) / ((2 * k + p + q) * (2 * k + p + q + 2))]
    c = 2 * k[1:] + p + q
    off = np.r_[4 * a * b / ((a + b) ** 2 * (a + b + 1)), 4 * k[1:] * (k[1:] + p) * (k[1:] + q) * (k[1:] + p + q) / (c * c * (c + 1) * (c - 1))]
    off = np.sqrt(off)
    x, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return np.clip(0.5 * (x + 1.0), 0.0, 1.0), vectors[0] ** 2


def dyadic_nodes(rate: float, n: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on (0, 1) in panels that halve towards 0, as many as an integrand falling like exp(-rate u) needs."""
    panels = max(1, math.ceil(math.log2(max(rate, 1.0) / 2.0)) + 1)
    u, w = unit_gauss_legendre(n)
    left = np.r_[0.0, 2.0 ** -np.arange(panels - 1.0, 0.0, -1.0)]
    width = np.diff(np.r_[left, 1.0])
    return (left[:, None] + width[:, None] * u).ravel(), (width[:, None] * w).ravel()


def hyp2f1_series(a, b, c, z, tol: float = 1e-14) -> np.ndarray:
    """Gauss power series for 0 <= z < 1. Each element is summed until it has converged and then leaves the loop."""
    a, b, c, z = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, c, z))
    shape = z.shape
    a, b, c, z = (v.ravel() for v in (a, b, c, z))
    out = np.ones(z.size)
    at = np.arange(z.size)
    total, term, n = np.ones(z.size), np.ones(z.size), 0
    while at.size:
        term = term * ((a + n) * (b + n) / ((c + n) * (1.0 + n))) * z
        total = total + term
        n += 1
        # past its peak the series falls at least like z^n, so the rest is below term / (1 - z)
        left = np.abs(term) > tol * (1.0 - z) * np.abs(total)
        if not left.all():
            out[at[~left]] = total[~left]
            at, a, b, c, z, total, term = (v[left] for v in (at, a, b, c, z, total, term))
    return out.reshape(shape)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: regularized incomplete gamma, series below the mean, continued fraction above."""
    if df <= 0 or x <= 0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def student_t_two_sided(t: float, df: float) -> float:
    """Two-sided Student-t tail by Gauss-Legendre over the angle: P = 2 c int_0^theta0 cos^(df-1)."""
    if not math.isfinite(t):
        return 0.0
    if df > 1e6:
        return normal_two_sided(t)
    # t = sqrt(df) tan(phi); the upper tail is the integral of cos^(df-1) from phi0 to pi/2
    rest = math.atan2(math.sqrt(df), abs(t))
    u, w = unit_gauss_legendre(200)
    # cos(pi/2 - s) = sin(s); most mass lies near s = rest, so square-map the nodes towards it
    s = rest * (1.0 - (1.0 - u) ** 3)
    jac = rest * 3.0 * (1.0 - u) ** 2
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    dens = np.exp(log_norm + (df - 1.0) * np.log(np.maximum(np.sin(s), 1e-300)))
    return float(min(1.0, 2.0 * np.sum(w * jac * dens)))
