"""Series state advanced by a block of new values (numpy; the state of one series)."""

import numpy as np

from .. import params
from ..operators.stats import trailing_order_stats

FRAMES = {"5": 5, "15": 15, "30": 30}


def empty() -> dict:
    return {"pos": 0, "mean": 0.0, "m2": 0.0, "lo": float("inf"), "hi": float("-inf"), "recent": np.zeros(0)}


def advance(state: dict, values: np.ndarray, vectors: bool = True) -> tuple[dict, dict]:
    """New state, and for every value the columns that the batch windows would give it; without ``vectors`` only those
    of the statistical check."""
    n0, size = state["pos"], len(values)
    base = state["mean"] if n0 else values[0]
    n = n0 + np.arange(1, size + 1)
    d = values - base  # relative to the mean so far: nothing cancels
    mean = np.cumsum(d) / n
    m2 = np.maximum(state["m2"] + np.cumsum(d * d) - n * mean * mean, 0.0)
    out = {
        "_pos": n,
        "count": n,
        "mean": base + mean,
        "std": np.sqrt(m2 / n),
        "min": np.minimum(np.minimum.accumulate(values), state["lo"]),
        "max": np.maximum(np.maximum.accumulate(values), state["hi"]),
    }
    past = state["recent"]
    joined = np.concatenate([past, values])
    start = params.QUARTILE_MIN_POINTS if len(past) < params.QUARTILE_WINDOW else params.QUARTILE_WINDOW
    q1, q3 = trailing_order_stats(joined, params.QUARTILE_WINDOW, start)
    out["q1"], out["q3"] = q1[len(past) :], q3[len(past) :]

    if vectors:
        out |= _windows(joined, size)
    after = {
        "pos": int(n[-1]),
        "mean": float(out["mean"][-1]),
        "m2": float(m2[-1]),
        "lo": float(out["min"][-1]),
        "hi": float(out["max"][-1]),
        "recent": joined[-params.QUARTILE_WINDOW :],
    }
    return after, out


def _windows(joined: np.ndarray, size: int) -> dict:
    """Columns of the last ``FRAMES`` rows of the newest ``size`` ones."""
    out, wide = {}, params.SEQUENCE_LENGTH
    padded = np.concatenate([np.full(wide, np.nan), joined])[-(size + wide - 1) :]
    frames = np.lib.stride_tricks.sliding_window_view(padded, wide)
    for name, k in FRAMES.items():
        out[f"_mean_{name}"] = np.nanmean(frames[:, wide - k :], axis=1)
        out[f"_std_{name}"] = np.nanstd(frames[:, wide - k :], axis=1)
    out["_min_30"], out["_max_30"] = np.nanmin(frames, axis=1), np.nanmax(frames, axis=1)
    short = min(size, max(0, wide - 1 - (len(joined) - size)))  # rows with fewer values before them
    out["_recent"] = [f[~np.isnan(f)].tolist() for f in frames[:short]] + frames[short:].tolist()
    out["_lag1"], out["_lag2"] = frames[:, -2], frames[:, -3]
    return out
