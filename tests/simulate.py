"""Simulated BG/NBD + Gamma-Gamma customers (test fixtures only)."""

from __future__ import annotations

import numpy as np
import pandas as pd


def simulate_bgnbd(n=20000, r=0.8, alpha=30.0, a=0.6, b=2.5, p=6.0, q=4.0, v=15.0, seed=7):
    rng = np.random.default_rng(seed)
    T = rng.uniform(60, 365, n)
    lam = rng.gamma(r, 1.0 / alpha, n)
    drop = rng.beta(a, b, n)
    nu = rng.gamma(q, 1.0 / v, n)
    rows = []
    for i in range(n):
        t, x, last, alive = 0.0, 0, 0.0, True
        while alive:
            t += rng.exponential(1.0 / lam[i])
            if t > T[i]:
                break
            x += 1
            last = t
            alive = rng.random() > drop[i]
        spend = rng.gamma(p, 1.0 / nu[i], x).mean() if x > 0 else 0.0
        rows.append((i, x, last, T[i], spend))
    return pd.DataFrame(rows, columns=["CustomerID", "frequency", "recency", "T", "monetary_value"])
