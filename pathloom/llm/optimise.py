"""A small optimiser for losses whose gradients Spark jobs sum up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y, rho in reversed(past):
            a = rho * (s @ d)
            kept.append(a)
            d = d - a * y
        if past:
            s, y, rho = past[-1]
            d = d / (rho * (y @ y))
        else:
            d = d / max(1.0, float(np.linalg.norm(g)))
        for (s, y, rho), a in zip(past, reversed(kept), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, step = float(g @ d), 1.0
        if slope > -1e-6 * max(1.0, abs(value)):
            break
        while True:
            new_value, new_g = f(w + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 4
            if step < 1e-4:
                return w
        s, y = step * d, new_g - g
        w, value, g = w + s, new_value, new_g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / float(s @ y))][-memory:]
    return w
