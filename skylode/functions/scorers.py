"""Scorers: what turns normalised frames into anomaly maps and scores. Any picklable object with these methods will do."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np

METHODS = ("recon", "topk", "max")


class Scorer(Protocol):
    """anomaly_map: frames (n × rows × channels) to maps (n × map rows × map columns), all cells non-negative. A scorer
    without it must offer scores(frames, method); candidates then have no ON/OFF stages."""

    def anomaly_map(self, frames: np.ndarray) -> np.ndarray: ...


def reduce_maps(maps: np.ndarray, method: str, frac: float = 0.01) -> np.ndarray:
    """The score of each map: mean of all cells, mean of the top fraction, or the largest cell."""
    flat = maps.reshape(len(maps), -1)
    if method == "recon":
        return flat.mean(1)
    if method == "max":
        return flat.max(1)
    if method == "topk":
        k = max(1, round(frac * flat.shape[1]))
        return np.sort(flat, axis=1)[:, -k:].mean(1)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")


class PooledSquares:
    """Mean of squares over blocks of rows × columns: no model, but deterministic and sensitive to bright cells."""

    def __init__(self, rows: int = 16, columns: int = 16):
        self.rows, self.columns = rows, columns

    def anomaly_map(self, frames: np.ndarray) -> np.ndarray:
        n, h, w = frames.shape
        return (frames**2).reshape(n, h // self.rows, self.rows, w // self.columns, self.columns).mean((2, 4))


_FACTORIES: dict[str, Callable[..., Scorer]] = {"pooled_squares": PooledSquares}


def register(name: str, factory: Callable[..., Scorer]) -> None:
    _FACTORIES[name] = factory


def build(name: str, **config) -> Scorer:
    if name not in _FACTORIES:
        raise ValueError(f"unknown scorer {name!r}; registered: {', '.join(sorted(_FACTORIES))}")
    return _FACTORIES[name](**config)
