"""Step rules of spectral projected gradients."""

from __future__ import annotations

from collections.abc import Callable

GAMMA, SIGMA, ALPHA, LEAST_STEP = 1e-4, (0.1, 0.9), (1e-3, 1e3), 1e-12


def next_step(step: float, slope: float, before: float, after: float) -> float:
    """The minimum of the parabola through what is known, if it lies within SIGMA of the step, else half the step."""
    bend = after - before - step * slope
    t = -0.5 * step * step * slope / bend if bend else 0.0
    return t if SIGMA[0] <= t <= SIGMA[1] * step else step / 2


def spectral_length(ss: float, sy: float) -> float:
    """Barzilai-Borwein length from <s, s> and <s, y>, kept within ALPHA."""
    return ALPHA[1] if sy <= 0 else min(ALPHA[1], max(ALPHA[0], ss / sy))


def line_search(f: Callable[[float], float], slope: float, memory: list[float]) -> tuple[float, float]:
    """(step, f(step)) that meets the non-monotone Armijo rule; step 0 if none does."""
    step, before = 1.0, f(0.0)
    while True:
        after = f(step)
        if after <= max(memory) + GAMMA * step * slope:
            return step, after
        step = next_step(step, slope, before, after)
        if abs(step) < LEAST_STEP:
            return 0.0, before


def parabola(value: float, slope: float, curvature: float) -> Callable[[float], float]:
    """f along a line where the cost is a quadratic: no pass over data for a trial step."""
    return lambda step: value + step * slope + step * step * curvature
