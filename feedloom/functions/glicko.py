"""Glicko-2 (Glickman 2012) for many players at once, with fractional games.

The sums over opponents are ordinary aggregates; only the volatility needs a
root finder, which runs over whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATING0, RD0, VOL0 = 1000.0, 350.0, 0.06
SCALE, TAU, RD_FLOOR, MOST_EFFECTIVE = 173.7178, 0.5, 30.0, 8


def g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / (np.pi**2))


def expected(mu: Column, mu_j: Column, phi_j: Column) -> Column:
    return 1 / (1 + F.exp(-g(phi_j) * (mu - mu_j)))


def solve_volatility(phi: np.ndarray, vol: np.ndarray, v: np.ndarray, delta: np.ndarray, tau: float = TAU) -> np.ndarray:
    """New volatilities: the root of the paper's step 5 by bisection, for all players in step."""
    a = np.log(vol**2)
    d2, p2 = delta**2, phi**2

    def f(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        return e * (d2 - p2 - v - e) / (2 * (p2 + v + e) ** 2) - (x - a) / tau**2

    excess = d2 - p2 - v
    low, high = a - tau, np.where(excess > 0, np.maximum(a, np.log(np.where(excess > 0, excess, 1.0))), a)
    for _ in range(100):
        out = f(low) < 0
        if not out.any():
            break
        low = np.where(out, low - tau, low)
    for _ in range(80):
        mid = (low + high) / 2
        up = f(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.exp((low + high) / 4)


def update_arrays(rating, rd, vol, v_inv, score_sum) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One rating period from the weighted sums of g^2 E (1 - E) and g (s - E)."""
    rating, rd, vol, v_inv, score_sum = (np.asarray(x, dtype=float) for x in (rating, rd, vol, v_inv, score_sum))
    mu, phi = (rating - RATING0) / SCALE, rd / SCALE
    played = v_inv > 0
    v = 1 / np.where(played, v_inv, 1.0)
    new_vol = np.where(played, solve_volatility(phi, vol, v, v * score_sum), vol)
    star = phi**2 + new_vol**2
    new_phi = np.where(played, 1 / np.sqrt(1 / star + 1 / v), phi)
    new_mu = np.where(played, mu + new_phi**2 * score_sum, mu)
    return SCALE * new_mu + RATING0, np.maximum(RD_FLOOR, SCALE * new_phi), new_vol


def update(rating: Column, rd: Column, vol: Column, v_inv: Column, score_sum: Column) -> Column:
    """struct(rating, rd, vol) after one rating period."""

    @F.pandas_udf("rating double, rd double, vol double")
    def step(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.DataFrame:
        new = update_arrays(a, b, c, d.fillna(0.0), e.fillna(0.0))
        return pd.DataFrame(dict(zip(("rating", "rd", "vol"), new)))

    return step(rating, rd, vol, v_inv, score_sum)
