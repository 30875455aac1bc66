"""Frame preprocessing in NumPy, applied to one window at a time inside vectorised tasks."""

from __future__ import annotations

import numpy as np


def bandpass(power: np.ndarray, degree: int = 3, method: str = "polynomial", rounds: int = 3, clip: float = 3.0) -> np.ndarray:
    """power (time × channels) divided by its bandpass: the channels' temporal median, or a polynomial fitted to it.

    The fit is made again `rounds` times, each time without the channels that lie beyond `clip` standard deviations of
    the residuals of those used before, and stays as it is once nothing deviates or too few channels are left. A floor
    keeps the divisor positive.
    """
    level = np.median(power.astype(float), axis=0)
    if method == "polynomial":
        x = np.linspace(-1.0, 1.0, len(level))

        def fitted(used: np.ndarray) -> np.ndarray:
            return np.polynomial.polynomial.polyval(x, np.polynomial.polynomial.polyfit(x[used], level[used], degree))

        used = np.ones(len(level), bool)
        fit = fitted(used)
        for _ in range(rounds):
            rest = level - fit
            sigma = rest[used].std()
            used = np.abs(rest) <= clip * sigma
            if sigma == 0 or used.sum() < degree + 1:
                break
            fit = fitted(used)
        level = fit
    elif method != "median":
        raise ValueError(f"unknown bandpass method {method!r}")
    return power / np.maximum(level, level.max() * 1e-4 + 1e-10)


def centred_log(frame: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """log1p of the non-negative part, minus its median, over its unscaled median absolute deviation."""
    f = np.log1p(np.maximum(frame, 0.0))
    f = f - np.median(f)
    return f / (np.median(np.abs(f)) + eps)


def normalise(window: np.ndarray, mode: str = "per_obs", degree: int | None = 3, eps: float = 1e-6) -> np.ndarray:
    """A window (observations × time × channels) as one frame of stacked observations.

    per_obs: each observation is flattened and normalised by itself; legacy_concat: all are stacked first. degree None
    leaves the bandpass out.
    """
    if mode not in ("per_obs", "legacy_concat"):
        raise ValueError(f"unknown normalisation mode {mode!r}")
    flat = [bandpass(o, degree) if degree is not None else o for o in window]
    if mode == "per_obs":
        return np.concatenate([centred_log(o, eps) for o in flat])
    return centred_log(np.concatenate(flat), eps)
