"""The features of one series stated with numpy, for comparison."""

import numpy as np


def spread(v):
    return (float(np.std(v)), float(np.mean(v))) if len(v) else (np.nan, np.nan)


def features(x, y, d, m):
    x, y, d, m = (np.asarray(v, dtype=float) for v in (x, y, d, m))
    top = y.max()
    peak = next(i for i, v in enumerate(y) if v == top)
    rise = [v for v in y[:peak] if v > 0]
    cost = [c for a, c in zip(x[:peak], d[:peak]) if a >= 0]
    right = [c for a, c in zip(x, m) if a >= 0]
    ratio = y / d
    best = next(i for i, v in enumerate(ratio) if v == ratio.max())
    rise_std, rise_mean = spread(np.diff(rise))
    fall_std, fall_mean = spread(np.diff(y[peak:]))
    cost_std, cost_mean = spread(np.diff(cost))
    return {
        "n_points": len(y),
        "peak_pos": peak,
        "n_fall": len(y) - peak,
        "ratioMax": ratio[best],
        "ratioMaxX": x[best],
        "yMax": top,
        "yStdRate": rise_std,
        "yMeanRate": rise_mean,
        "yStdFallRate": fall_std,
        "yMeanFallRate": abs(fall_mean),
        "dMax": max(cost) if cost else np.nan,
        "dStdRate": cost_std,
        "dMeanRate": cost_mean,
        "mAtZero": abs(right[0]) if right else np.nan,
    }
