"""Logistic calibration of a few features."""

from __future__ import annotations

import math

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> dict:
    """Logistic regression by damped Newton steps, on standardised features. One class only: its smoothed share."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0) if len(x) else np.ones(x.shape[1])
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log(rate / (1 - rate))
    if len(set(y.tolist())) > 1:
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        keep = np.r_[np.full(x.shape[1], ridge * len(x)), 0]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * w)
            w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-7:
                break
    return {"mean": mean, "scale": scale, "w": w}


def apply_logistic(m: dict, x: np.ndarray) -> np.ndarray:
    z = (x - m["mean"]) / m["scale"]
    return 1 / (1 + np.exp(-np.clip(z @ m["w"][:-1] + m["w"][-1], -30, 30)))
