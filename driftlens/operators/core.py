"""Numerics of the models on arrays: what one series' task, or the driver, runs.

Rows of X are samples in order of time. Nothing here needs more than numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field

import numpy as np

from driftlens.functions.stochastic import left_stochastic, right_stochastic
from driftlens.operators import spg


def project_rows(a: np.ndarray) -> np.ndarray:
    """Euclidean projection of each row on the simplex; a row with NaN gives 0 everywhere."""
    a = np.atleast_2d(np.asarray(a, float))
    if np.isnan(a).any():
        whole = ~np.isnan(a).any(1)
        out = np.zeros_like(a)
        out[whole] = project_rows(a[whole])
        return out
    down = -np.sort(-a, axis=1)
    theta = ((np.cumsum(down, axis=1) - 1) / np.arange(1, a.shape[1] + 1)).max(axis=1, keepdims=True)
    return np.maximum(a - theta, 0)


def project_columns(a: np.ndarray) -> np.ndarray:
    return project_rows(np.asarray(a).T).T


#: Called with (iteration, cost, change of cost) while a fit runs.
Progress = Callable[[int, float, float], None]


def check_init(init: str, starts: dict[str, object]) -> None:
    """Raises for an unknown kind of start, and for "custom" without all its arrays."""
    if init not in ("random", "furthest_sum", "custom"):
        raise ValueError(f"init must be random, furthest_sum or custom: {init!r}")
    if init == "custom" and (missing := sorted(n for n, v in starts.items() if v is None)):
        raise ValueError(f"init custom needs {', '.join(missing)}")


def check_start(array: np.ndarray | None, shape: tuple[int, ...], sums_along: int | None) -> None:
    """Raises unless an array that is given has this shape, is finite and sums to 1 along an axis, if one is named."""
    if array is None:
        return
    array = np.asarray(array, float)
    if array.shape != shape:
        raise ValueError(f"a start has shape {array.shape}, not {shape}")
    if not np.isfinite(array).all():
        raise ValueError("a start has values that are not finite")
    if sums_along is not None and (array.min() < -1e-8 or not np.allclose(array.sum(sums_along), 1)):
        raise ValueError("a start is not on the simplex")


@dataclass
class Trace:
    """Costs by iteration and whether the last change was below the tolerance."""

    costs: list[float] = field(default_factory=list)
    converged: bool = False
    progress: Progress | None = None

    def step(self, cost: float, tolerance: float, monotonic: bool) -> bool:
        """Notes a cost; True if it is time to stop."""
        if self.costs and monotonic and cost > self.costs[-1] + max(tolerance, 1e-9 * abs(cost)):
            raise RuntimeError(f"the cost rose from {self.costs[-1]} to {cost}")
        self.converged = bool(self.costs) and abs(self.costs[-1] - cost) < tolerance
        self.costs.append(cost)
        if self.progress:
            self.progress(len(self.costs) - 1, cost, cost - self.costs[-2] if len(self.costs) > 1 else float("nan"))
        return self.converged


class Block:
    """One block of variables with its spectral length and memory of costs."""

    def __init__(self, memory: int = 1):
        self.alpha, self.memory, self.size = 1.0, [], memory

    def quadratic(self, x: np.ndarray, gradient: np.ndarray, project, cost: float, curvature) -> np.ndarray:  # noqa: ANN001
        """A projected step where the cost is quadratic; curvature(direction) is the coefficient of step^2."""
        direction = project(x - self.alpha * gradient) - x
        slope, bend = float((gradient * direction).sum()), float(curvature(direction))
        self.memory = [*self.memory, cost][-self.size :]
        step, _ = spg.line_search(spg.parabola(cost, slope, bend), slope, self.memory)
        self.alpha = spg.spectral_length(step * step * float((direction * direction).sum()), 2 * step * step * bend)
        return x + step * direction


# --- convex coding -----------------------------------------------------------


def coding_loss(x: np.ndarray, gamma: np.ndarray, states: np.ndarray) -> float:
    return float(((x - gamma @ states) ** 2).sum() / x.size)


def pair_penalty(states: np.ndarray, epsilon: float) -> float:
    """Scaled sum of squared distances between states."""
    k, d = states.shape
    if k == 1:
        return 0.0
    gram = states @ states.T
    return float(epsilon * 2 * (k * np.trace(gram) - gram.sum()) / (k * d * (k - 1)))


def pair_penalty_gradient(states: np.ndarray, epsilon: float) -> np.ndarray:
    k, d = states.shape
    return np.zeros_like(states) if k == 1 else 4 * epsilon / (d * k * (k - 1)) * (k * states - states.sum(0))


def mtd_predicted(gamma: np.ndarray, weights: np.ndarray, transitions: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """Weights that the mixture of transitions predicts; the first max(lags) rows are as they are."""
    m, out = max(lags), gamma.copy()
    out[m:] = sum(w * gamma[m - lag : len(gamma) - lag] @ t.T for w, t, lag in zip(weights, transitions, lags, strict=True))
    return out


def mtd_penalty(gamma: np.ndarray, weights: np.ndarray, transitions: np.ndarray, lags: Sequence[int], epsilon: float = 1.0) -> float:
    n, k = gamma.shape
    if k == 1 or n <= max(lags):
        return 0.0
    return float(epsilon * ((gamma - mtd_predicted(gamma, weights, transitions, lags)) ** 2).sum() / (k * (n - max(lags))))


def mtd_penalty_gradient(gamma: np.ndarray, weights: np.ndarray, transitions: np.ndarray, lags: Sequence[int], epsilon: float) -> np.ndarray:
    n, k = gamma.shape
    if k == 1 or n <= max(lags):
        return np.zeros_like(gamma)
    r = gamma - mtd_predicted(gamma, weights, transitions, lags)
    out = r.copy()
    for w, t, lag in zip(weights, transitions, lags, strict=True):
        out[: n - lag] -= w * r[lag:] @ t
    return 2 * epsilon / (k * (n - max(lags))) * out


def moments_of(gamma: np.ndarray, lags: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    m, n = max(lags), len(gamma)
    part = {a: gamma[m - a : n - a] for a in (0, *lags)}
    return {(a, b): part[a].T @ part[b] for a in part for b in part}


def fit_mtd_parameters(moments: dict[tuple[int, int], np.ndarray], lags: Sequence[int], n: int, weights: np.ndarray, transitions: np.ndarray, block: Block, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """One projected step on order weights and transitions, from lagged moments alone; returns the penalty after it too."""
    k = transitions.shape[1]
    c = scale / (k * max(1, n - max(lags)))
    all_ = (0, *lags)

    def coefficients(w: np.ndarray, t: np.ndarray) -> dict[int, np.ndarray]:
        return {0: np.eye(k), **{lag: -wi * ti for wi, ti, lag in zip(w, t, lags, strict=True)}}

    def cost(w: np.ndarray, t: np.ndarray) -> float:
        co = coefficients(w, t)
        return float(c * sum(np.trace(co[a] @ moments[a, b] @ co[b].T) for a in all_ for b in all_))

    co = coefficients(weights, transitions)
    rg = [sum(co[a] @ moments[a, lag] for a in all_) for lag in lags]
    gw = np.array([-2 * c * (t * r).sum() for t, r in zip(transitions, rg, strict=True)])
    gt = np.stack([-2 * c * w * r for w, r in zip(weights, rg, strict=True)])
    dw = project_rows(weights - block.alpha * gw)[0] - weights
    dt = np.stack([project_columns(t - block.alpha * g) - t for t, g in zip(transitions, gt, strict=True)])
    slope, now = float(gw @ dw + (gt * dt).sum()), cost(weights, transitions)
    block.memory = [*block.memory, now][-block.size :]
    step, after = spg.line_search(lambda s: cost(weights + s * dw, transitions + s * dt), slope, block.memory)
    new_w, new_t = weights + step * dw, transitions + step * dt
    co = coefficients(new_w, new_t)
    rg = [sum(co[a] @ moments[a, lag] for a in all_) for lag in lags]
    yw = np.array([-2 * c * (t * r).sum() for t, r in zip(new_t, rg, strict=True)]) - gw
    yt = np.stack([-2 * c * w * r for w, r in zip(new_w, rg, strict=True)]) - gt
    block.alpha = spg.spectral_length(step * step * float((dw * dw).sum() + (dt * dt).sum()), step * float(dw @ yw + (dt * yt).sum()))
    return new_w, new_t, after


@dataclass
class Coding:
    """A convex coding: weights, states, and the Markov mixture where there is one."""

    gamma: np.ndarray
    states: np.ndarray
    trace: Trace
    order_weights: np.ndarray | None = None
    transitions: np.ndarray | None = None


def check_lags(lags: Sequence[int]) -> list[int]:
    out = [int(x) for x in lags]
    if not out or min(out) < 1 or len(set(out)) != len(out):
        raise ValueError(f"lags must be distinct positive integers: {list(lags)}")
    return out


def random_mtd(k: int, lags: Sequence[int], state: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    w = state.uniform(size=len(lags))
    return w / w.sum(), np.stack([left_stochastic((k, k), state) for _ in lags])


def fit_coding(
    x: np.ndarray, k: int, epsilon_states: float = 0.0, lags: Sequence[int] = (), epsilon_weights: float = 0.0, gamma: np.ndarray | None = None, states: np.ndarray | None = None,
    mixture: tuple[np.ndarray, np.ndarray] | None = None, tolerance: float = 1e-6, max_iterations: int = 1000, seed: int = 0, update: Sequence[str] = ("states", "weights", "parameters"), monotonic: bool = True,
    memory: int = 1, init: str = "random", progress: Progress | None = None, extra_steps: int = 10,
) -> Coding:
    """Alternates steps on states, weights and (with lags) parameters of the mixture.

    init is "random", "furthest_sum" (states are rows of x far from each other)
    or "custom" (states, gamma and, with lags, mixture are given). A line search
    compares with the largest of the last `memory` costs.
    """
    rng, c = np.random.RandomState(seed), 1 / x.size
    check_init(init, {"states": states, "gamma": gamma, **({"mixture": mixture} if len(lags) else {})})
    check_start(states, (k, x.shape[1]), None)
    check_start(gamma, (len(x), k), 1)
    if mixture is not None:
        check_start(mixture[0][None], (1, len(lags)), 1)
        check_start(np.concatenate(list(mixture[1])), (len(lags) * k, k), None)
        for matrix in mixture[1]:
            check_start(matrix, (k, k), 0)
    if states is None and init == "furthest_sum":
        states = x[furthest_rows(x, k, int(rng.randint(len(x))), extra_steps)].astype(float)
    if states is None:
        states = np.sqrt(np.abs(x).mean() / k) * rng.standard_normal((k, x.shape[1]))
    if gamma is None:
        gamma = right_stochastic((len(x), k), rng)
    w, t = mixture or (random_mtd(k, lags, rng) if len(lags) else (None, None))
    blocks, trace = {n: Block(memory) for n in ("states", "weights", "parameters")}, Trace(progress=progress)
    n, m = len(x), max(lags, default=0)

    def penalty(g: np.ndarray) -> float:
        return mtd_penalty(g, w, t, lags, epsilon_weights) if len(lags) else 0.0

    def cost() -> float:
        return coding_loss(x, gamma, states) + pair_penalty(states, epsilon_states) + penalty(gamma)

    trace.step(cost(), tolerance, monotonic)
    for _ in range(max_iterations):
        if "states" in update:
            gtg = gamma.T @ gamma
            gradient = pair_penalty_gradient(states, epsilon_states) + 2 * c * (gtg @ states - gamma.T @ x)
            states = blocks["states"].quadratic(states, gradient, lambda z: z, cost(), lambda d: c * (gtg * (d @ d.T)).sum() + pair_penalty(d, epsilon_states))
        if "weights" in update and k > 1:
            gradient = 2 * c * (gamma @ (states @ states.T) - x @ states.T)
            if len(lags):
                gradient = gradient + mtd_penalty_gradient(gamma, w, t, lags, epsilon_weights)

            def bend(d: np.ndarray, s: np.ndarray = states) -> float:
                out = c * ((d @ s) ** 2).sum()
                if len(lags) and n > m:
                    r = d - mtd_predicted(d, w, t, lags)
                    out += epsilon_weights / (k * (n - m)) * (r[m:] ** 2).sum()
                return out

            gamma = blocks["weights"].quadratic(gamma, gradient, project_rows, cost(), bend)
        if "parameters" in update and len(lags) and n > m and k > 1:
            w, t, _ = fit_mtd_parameters(moments_of(gamma, lags), lags, n, w, t, blocks["parameters"], max(epsilon_weights, 1e-300))
        if trace.step(cost(), tolerance, monotonic):
            break
    return Coding(gamma, states, trace, w, t)


def fit_mixture(moments: dict[tuple[int, int], np.ndarray], lags: Sequence[int], n: int, k: int, tolerance: float = 1e-12, max_iterations: int = 5000, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The Markov mixture of fixed weights, from their lagged moments.

    Steps end when one changes the cost by less than that share of it. Where
    weights hardly move in time that is far from the end, so the programme is
    solved from there by active sets.
    """
    w, t = random_mtd(k, lags, np.random.RandomState(seed))
    block, before = Block(), np.inf
    for _ in range(max_iterations):
        w, t, now = fit_mtd_parameters(moments, lags, n, w, t, block)
        if abs(before - now) <= tolerance * now:
            break
        before = now
    w, t = solved_mixture(moments, lags, w, t)
    return w, t, mixture_cost(moments, lags, n, w, t)


def mixture_cost(moments: dict[tuple[int, int], np.ndarray], lags: Sequence[int], n: int, weights: np.ndarray, transitions: np.ndarray) -> float:
    """mtd_penalty with epsilon 1, from lagged moments."""
    k = transitions.shape[1]
    co = {0: np.eye(k), **{lag: -w * t for w, t, lag in zip(weights, transitions, lags, strict=True)}}
    return float(sum(np.trace(co[a] @ moments[a, b] @ co[b].T) for a in co for b in co) / (k * max(1, n - max(lags))))


def solved_mixture(moments: dict[tuple[int, int], np.ndarray], lags: Sequence[int], weights: np.ndarray, transitions: np.ndarray, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Order weights and transitions of least cost, by active sets from a start.

    With B = w T the cost is a convex quadratic of the entries of B, which are
    not negative, whose columns have one sum for each lag, and those sums add
    up to 1.
    """
    k, m = transitions.shape[1], len(lags)
    within = np.block([[moments[a, b] for b in lags] for a in lags])
    size = np.trace(within) or 1.0
    quadratic = np.kron(np.eye(k), within / size)
    linear = np.hstack([moments[0, lag] for lag in lags]).ravel() / size
    # x is B row by row: (state now, lag, state before)
    columns = np.kron(np.ones(k), np.eye(k * m)).reshape(k * m, -1)
    own = [columns[l * k + j] - columns[l * k] for l in range(m) for j in range(1, k)]  # noqa: E741
    equal = np.vstack([*own, columns[::k].sum(0)])
    x = np.hstack(list(weights[:, None, None] * transitions)).ravel()
    free = x > 1e-9
    x = np.where(free, x, 0.0)
    target, at = np.r_[np.zeros(len(own)), 1.0], 1e-11
    for _ in range(rounds):
        some = equal[:, free]
        system = np.block([[quadratic[np.ix_(free, free)], some.T], [some, np.zeros((len(equal), len(equal)))]])
        got = np.linalg.lstsq(system, np.r_[(linear - quadratic @ x)[free], target - equal @ x], rcond=None)[0]
        step, multipliers = np.zeros_like(x), got[free.sum() :]
        step[free] = got[: free.sum()]
        shrinks = free & (step < -at)
        share = np.min(x[shrinks] / -step[shrinks], initial=1.0)
        x = x + share * step
        if share < 1.0:
            ends = shrinks & (x <= at)
            x[ends], free = 0.0, free & ~ends
            continue
        x = np.maximum(x, 0.0)
        slack = np.where(free, 0.0, quadratic @ x - linear + equal.T @ multipliers)
        if slack.min() >= -at:
            break
        free[slack.argmin()] = True
    else:
        raise RuntimeError(f"the mixture is not found within {rounds} rounds")
    b = x.reshape(k, m, k).transpose(1, 0, 2)
    w = b.sum((1, 2)) / k
    # a lag without weight keeps its transitions
    t = np.stack([project_columns(bi / wi) if wi > at else ti for bi, wi, ti in zip(b, w, transitions, strict=True)])
    return w / w.sum(), t


def regressed_transitions(moments: dict[tuple[int, int], np.ndarray], lag: int) -> np.ndarray:
    """Transitions of one lag by least squares without bounds, each column projected on the simplex afterwards."""
    return project_columns(np.linalg.lstsq(moments[lag, lag], moments[lag, 0], rcond=None)[0].T)


def companion(weights: np.ndarray, transitions: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """The matrix that moves the last max(lags) weights, newest first, one step on."""
    k, m = transitions.shape[1], max(lags)
    out = np.eye(k * m, k=-k)
    for w, t, lag in zip(weights, transitions, lags, strict=True):
        out[:k, (lag - 1) * k : lag * k] += w * t
    return out


def forecast_blocks(weights: np.ndarray, transitions: np.ndarray, lags: Sequence[int], horizon: int) -> list[np.ndarray]:
    """M[j] such that the forecast is the sum of M[j] gamma(t - j), j from 0 below max(lags)."""
    k, m = transitions.shape[1], max(lags)
    top = np.linalg.matrix_power(companion(weights, transitions, lags), horizon)[:k]
    return [top[:, j * k : (j + 1) * k] for j in range(m)]


# --- archetypes --------------------------------------------------------------


@dataclass
class Archetypes:
    """S (samples by k), C (k by samples), Z = C X."""

    weights: np.ndarray
    dictionary: np.ndarray
    states: np.ndarray
    trace: Trace
    scales: np.ndarray


def furthest_rows(x: np.ndarray, k: int, start: int = 0, extra_steps: int = 10) -> list[int]:
    """Furthest-sum picks on an array."""
    return _furthest(lambda i: np.sqrt(np.maximum(((x - x[i]) ** 2).sum(1), 0)), len(x), k, start, extra_steps)


def _furthest(distance: Callable[[int], np.ndarray], n: int, k: int, start: int, extra_steps: int) -> list[int]:
    def furthest(picked: list[int]) -> int:
        sums = sum(distance(i) for i in picked)
        sums[picked] = -1
        return int(sums.argmax())

    picked = [start]
    while len(picked) < k:
        picked.append(furthest(picked))
    for step in range(extra_steps if 1 < k < n else 0):
        others = picked[: step % k] + picked[step % k + 1 :]
        picked[step % k] = furthest(others)
    return picked


class _Linear:
    """Products of samples where the kernel is linear: nothing of the size of all pairs exists."""

    def __init__(self, x: np.ndarray):
        self.x, self.total = x, float((x * x).sum())

    def mixed(self, dictionary: np.ndarray) -> np.ndarray:
        """C X (k by features)."""
        return dictionary @ self.x

    def with_samples(self, mixed: np.ndarray) -> np.ndarray:
        """Products of mixtures and samples (k by samples)."""
        return mixed @ self.x.T

    def between(self, mixed: np.ndarray, dictionary: np.ndarray) -> np.ndarray:
        """Products of mixtures with each other (k by k)."""
        return mixed @ mixed.T


class _Kernel(_Linear):
    """The same from a kernel matrix of all samples; a mixture is C K."""

    def __init__(self, matrix: np.ndarray):
        if matrix.ndim != 2 or len(matrix) != matrix.shape[1] or not np.allclose(matrix, matrix.T, atol=1e-8):
            raise ValueError(f"a kernel matrix must be square and symmetric; its shape is {matrix.shape}")
        self.matrix, self.total = matrix, float(np.trace(matrix))

    def mixed(self, dictionary: np.ndarray) -> np.ndarray:
        return dictionary @ self.matrix

    def with_samples(self, mixed: np.ndarray) -> np.ndarray:
        return mixed

    def between(self, mixed: np.ndarray, dictionary: np.ndarray) -> np.ndarray:
        return mixed @ dictionary.T


def fit_archetypes(
    x: np.ndarray, k: int, delta: float = 0.0, dictionary: np.ndarray | None = None, weights: np.ndarray | None = None, init: str = "furthest_sum", tolerance: float = 1e-6, max_iterations: int = 1000, seed: int = 0,
    update: Sequence[str] = ("dictionary", "weights"), monotonic: bool = True, memory: int = 1, kernel: bool = False, progress: Progress | None = None, extra_steps: int = 10,
) -> Archetypes:
    """X is near S C X, with rows of S and of C on the simplex; rows of C may be scaled by 1 - delta to 1 + delta.

    With kernel, x is the matrix K of products of all samples, and the distance
    of samples to S C X is taken where K is the product; states are C K then.
    """
    rng, n = np.random.RandomState(seed), len(x)
    own = _Kernel(x) if kernel else _Linear(x)
    check_init(init, {"dictionary": dictionary, "weights": weights})
    check_start(dictionary, (k, n), 1)
    check_start(weights, (n, k), 1)
    if dictionary is None:
        if init == "random":
            dictionary = right_stochastic((k, n), rng)
        else:
            dictionary = np.zeros((k, n))
            start = int(rng.randint(n))
            dictionary[np.arange(k), furthest_by_kernel(x, k, start, extra_steps) if kernel else furthest_rows(x, k, start, extra_steps)] = 1
    s = right_stochastic((n, k), rng) if weights is None else np.asarray(weights, float)
    scales, blocks, trace = np.ones(k), {m: Block(memory) for m in ("dictionary", "weights")}, Trace(progress=progress)

    def products() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Z, its products with samples, and with itself, of the scaled dictionary."""
        z = scales[:, None] * own.mixed(dictionary)
        return z, own.with_samples(z), own.between(z, scales[:, None] * dictionary)

    z, zx, zz = products()

    def cost() -> float:
        return float(own.total - 2 * (s.T * zx).sum() + ((s.T @ s) * zz).sum())

    def bend(d: np.ndarray, sts: np.ndarray) -> float:
        scaled = scales[:, None] * d
        return float((sts * own.between(own.mixed(scaled), scaled)).sum())

    trace.step(cost(), tolerance, monotonic)
    for _ in range(max_iterations):
        if "dictionary" in update:
            sts = s.T @ s
            slope = scales[:, None] * own.with_samples(2 * (sts @ z - own.mixed(s.T)))
            dictionary = blocks["dictionary"].quadratic(dictionary, slope, project_rows, cost(), lambda d, sts=sts: bend(d, sts))
            if delta > 0:  # a coordinate step on each scale, with its exact minimum inside the bounds
                base = own.mixed(dictionary)
                to_samples, gram = own.with_samples(base), own.between(base, dictionary)
                for i in range(k):
                    weight = sts[i, i] * gram[i, i]
                    if weight > 0:
                        left = s.T[i] @ to_samples[i] - sum(sts[i, j] * scales[j] * gram[i, j] for j in range(k) if j != i)
                        scales[i] = np.clip(left / weight, 1 - delta, 1 + delta)
            z, zx, zz = products()
        if "weights" in update:
            s = blocks["weights"].quadratic(s, 2 * (s @ zz - zx.T), project_rows, cost(), lambda d, g=zz: float(((d.T @ d) * g).sum()))
        if trace.step(cost(), tolerance, monotonic):
            break
    return Archetypes(s, dictionary, z, trace, scales)


def furthest_by_kernel(matrix: np.ndarray, k: int, start: int = 0, extra_steps: int = 10) -> list[int]:
    """Furthest-sum picks by the distances that a kernel matrix implies."""
    own = np.diag(matrix)
    return _furthest(lambda i: np.sqrt(np.maximum(own + own[i] - 2 * matrix[i], 0)), len(matrix), k, start, extra_steps)


@dataclass
class Landmarks:
    """Archetypes by a kernel as mixtures of a few fitted samples, by which new rows get their weights."""

    rows: np.ndarray
    mix: np.ndarray
    products: np.ndarray


def landmarks(x: np.ndarray, matrix: np.ndarray, dictionary: np.ndarray, scales: np.ndarray, number: int) -> Landmarks:
    """The projections of archetypes on the span of `number` samples that are far from each other by the kernel."""
    picks = furthest_by_kernel(matrix, min(number, len(x)), int(dictionary.max(0).argmax()), 0)
    shares = scales[:, None] * dictionary
    mix = shares @ matrix[:, picks] @ np.linalg.pinv(matrix[np.ix_(picks, picks)], rcond=1e-10, hermitian=True)
    return Landmarks(x[picks], mix, shares @ matrix @ shares.T)


def weights_by_products(with_archetypes: np.ndarray, between: np.ndarray, tolerance: float, max_iterations: int) -> np.ndarray:
    """Weights of rows on archetypes of which only products are known: of rows with archetypes, and of archetypes."""
    values, vectors = np.linalg.eigh(between)
    root = vectors * np.sqrt(np.maximum(values, 0))  # archetypes as points with these products
    x = with_archetypes @ np.linalg.pinv(root, rcond=1e-10).T
    return fit_coding(x, len(between), tolerance=tolerance, max_iterations=max_iterations, states=root, update=("weights",)).gamma


# --- autoregression ----------------------------------------------------------


def design(y: np.ndarray, p: int, u: np.ndarray | None = None, s: int = 0, trend: bool = True, contemporaneous: bool = True) -> np.ndarray:
    """[1, y lags 1 to p, u lags 1 to s, u now] for rows from max(p, s) on."""
    n, m = len(y), max(p, s)
    parts = [np.ones((n - m, 1))] if trend else []
    parts += [y[m - k : n - k] for k in range(1, p + 1)]
    if u is not None:
        parts += [u[m - k : n - k] for k in range(1, s + 1)]
        parts += [u[m:]] if contemporaneous else []
    return np.hstack(parts) if parts else np.empty((n - m, 0))


@dataclass
class Autoregression:
    """Stacked coefficients (design columns by outputs), their parts, and the noise."""

    coefficients: np.ndarray
    mu: np.ndarray
    a: np.ndarray
    b: np.ndarray
    b0: np.ndarray | None
    sigma: np.ndarray | None

    def residuals(self, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        return y[len(y) - len(z) :] - z @ self.coefficients

    @property
    def precision(self) -> np.ndarray | None:
        """The inverse of the noise covariance; None where there is none or it is singular."""
        if self.sigma is None or np.linalg.matrix_rank(self.sigma) < len(self.sigma):
            return None
        return np.linalg.inv(self.sigma)


def unpack(coefficients: np.ndarray, d: int, p: int, m: int, s: int, trend: bool, contemporaneous: bool, sigma: np.ndarray | None) -> Autoregression:
    at = int(trend)
    mu = coefficients[0] if trend else np.zeros(d)
    a = np.stack([coefficients[at + k * d : at + (k + 1) * d].T for k in range(p)]) if p else np.zeros((0, d, d))
    at += p * d
    b = np.stack([coefficients[at + k * m : at + (k + 1) * m].T for k in range(s)]) if s and m else np.zeros((0, d, m))
    at += s * m
    return Autoregression(coefficients, mu, a, b, coefficients[at : at + m].T if m and contemporaneous else None, sigma)


def fit_autoregression(y: np.ndarray, p: int, u: np.ndarray | None = None, s: int = 0, weights: np.ndarray | None = None, trend: bool = True, contemporaneous: bool = True) -> Autoregression:
    """Least squares of least norm; with weights, weighted. The noise covariance is None where its degrees of freedom run out."""
    y = y.reshape(len(y), -1)
    z, target = design(y, p, u, s, trend, contemporaneous), y[max(p, s) :]
    m = 0 if u is None else u.shape[1]
    if weights is not None and len(weights) != len(z):
        raise ValueError(f"there are {len(weights)} weights for {len(z)} rows")
    root = np.ones(len(z)) if weights is None else np.sqrt(np.maximum(weights, 0))
    coefficients = np.linalg.lstsq(root[:, None] * z, root[:, None] * target, rcond=None)[0]
    e = target - z @ coefficients
    free = len(z) - z.shape[1] if weights is None else weights.sum() - 1
    w = np.ones(len(z)) if weights is None else weights
    sigma = (e * w[:, None]).T @ e / free if free > 0 else None
    return unpack(coefficients, y.shape[1], p, m, s, trend, contemporaneous, sigma)


def from_gram(gram: np.ndarray, d: int, n: int, p: int, m: int, s: int, trend: bool, contemporaneous: bool) -> Autoregression:
    """Least squares of the last d columns on the others, from the sums of products of all.

    Columns are scaled to unit length and small directions are dropped, which
    is the solution of least norm where the design is rank-deficient.
    """
    q = len(gram) - d
    zz, zy, yy = gram[:q, :q], gram[:q, q:], gram[q:, q:]
    unit = np.sqrt(np.maximum(np.diag(zz), 1e-300))
    b = np.linalg.pinv(zz / np.outer(unit, unit), rcond=1e-12, hermitian=True) @ (zy / unit[:, None]) / unit[:, None]
    e = yy - zy.T @ b - b.T @ zy + b.T @ zz @ b
    return unpack(b, d, p, m, s, trend, contemporaneous, e / (n - q) if n > q else None)


def from_factor(r: np.ndarray, d: int, n: int, p: int, m: int, s: int, trend: bool, contemporaneous: bool) -> Autoregression:
    """Least squares of least norm of the last d columns on the others, from the triangle of all (moments.factor). Condition numbers are not squared, as they are in from_gram."""
    q = r.shape[1] - d
    b = np.linalg.lstsq(r[:, :q], r[:, q:], rcond=None)[0]
    e = r[:, q:] - r[:, :q] @ b
    return unpack(b, d, p, m, s, trend, contemporaneous, e.T @ e / (n - q) if n > q else None)


# --- regimes of bounded variation --------------------------------------------


def total_variation(gamma: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(gamma, axis=0)).sum(0)


def _cheapest_path(distance: np.ndarray, toll: np.ndarray) -> np.ndarray:
    """Labels of least cost where a switch from i to j costs toll[i] + toll[j]."""
    n, k = distance.shape
    move = toll[:, None] + toll[None, :]
    np.fill_diagonal(move, 0)
    best, came = distance[0].copy(), np.zeros((n, k), int)
    for t in range(1, n):
        options = best[:, None] + move
        came[t] = options.argmin(0)
        best = options[came[t], np.arange(k)] + distance[t]
    path = np.zeros(n, int)
    path[-1] = best.argmin()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def mixture_of_paths(k: int, bound: float, max_columns: int = 100_000) -> Generator[np.ndarray | None, object, list[tuple[int, float]]]:
    """Solves the linear programme of bounded variation over mixtures of label paths, by whoever can price paths.

    Revised simplex on k + 1 rows. First it is sent the costs of the k constant
    paths, of which the cheapest is column 0 and feasible. Then it yields tolls
    and is sent (cost, turns) of the path of least cost with tolls paid, which is
    the next column. It returns the columns of the solution and their shares.
    Raises if max_columns paths do not bring it to its end.
    """
    totals = yield None
    columns = [(float(np.min(totals)), np.zeros(k))]
    basis: list[int] = [-1 - i for i in range(k)] + [0]  # below 0: slack of component -1 - i

    def column(which: int) -> np.ndarray:
        return np.eye(k + 1)[-1 - which] if which < 0 else np.append(columns[which][1], 1.0)

    def price(which: int) -> float:
        return 0.0 if which < 0 else columns[which][0]

    right = np.append(np.full(k, float(bound)), 1.0)
    matrix = np.stack([column(b) for b in basis], 1)
    for _ in range(max_columns):
        dual = np.linalg.solve(matrix.T, np.array([price(b) for b in basis]))
        enter, worst = None, int(dual[:k].argmax())
        if dual[worst] > 1e-9 and -1 - worst not in basis:
            enter = -1 - worst
        else:
            columns.append((yield np.maximum(-dual[:k], 0)))
            if price(len(columns) - 1) - dual @ column(len(columns) - 1) < -1e-9 * max(1.0, abs(dual[k])):
                enter = len(columns) - 1
        if enter is None:
            break
        change, value = np.linalg.solve(matrix, column(enter)), np.linalg.solve(matrix, right)
        ratio = np.where(change > 1e-12, value / np.where(change > 1e-12, change, 1), np.inf)
        if not np.isfinite(ratio.min()):  # shares sum to 1 and slacks lie within the bound, so some share must fall
            raise RuntimeError("the programme of bounded variation is numerically singular")
        leave = min((basis[i], i) for i in np.flatnonzero(ratio <= ratio.min() + 1e-12))[1]
        basis[leave] = enter
        matrix[:, leave] = column(enter)
    else:
        raise RuntimeError(f"weights of bounded variation are not found within {max_columns} columns")
    share = np.maximum(np.linalg.solve(matrix, right), 0)
    return [(b, float(x)) for b, x in zip(basis, share, strict=True) if b >= 0 and x > 0]


def bounded_weights(distance: np.ndarray, bound: float | None, max_columns: int = 100_000) -> np.ndarray:
    """Weights on the simplex of least cost whose total variation is at most bound in each component.

    Without a bound (None or negative) each row goes to its nearest component.
    With one, a dynamic programme finds the paths that mixture_of_paths asks for.
    """
    n, k = distance.shape
    if bound is None or bound < 0 or k == 1:
        return np.eye(k)[distance.argmin(1)]
    solve, paths = mixture_of_paths(k, bound, max_columns), [np.full(n, int(distance.sum(0).argmin()))]
    next(solve)
    answer: object = distance.sum(0)
    while True:
        try:
            toll = solve.send(answer)
        except StopIteration as end:
            shares = end.value
            break
        paths.append(_cheapest_path(distance, toll))
        answer = float(distance[np.arange(n), paths[-1]].sum()), total_variation(np.eye(k)[paths[-1]])
    out = np.zeros((n, k))
    for which, share in shares:
        out[np.arange(n), paths[which]] += share
    return out / out.sum(1, keepdims=True)


@dataclass
class Regimes:
    """Weights, parameters of the components, and costs."""

    gamma: np.ndarray
    trace: Trace
    parameters: object


def centroids(x: np.ndarray, gamma: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Weighted means; a component without weight keeps its centre."""
    mass = gamma.sum(0)
    return np.where(mass[:, None] > 0, gamma.T @ x / np.where(mass > 0, mass, 1)[:, None], before)


def centroids_of(gtx: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Weighted means from sums over rows; NaN without weight."""
    return gtx / np.where(mass > 0, mass, np.nan)


class Family:
    """What a component of a regime model is: three hooks, and its parameters as tables.

    Rows before `skipped` have no distance. Where start cannot tell components
    apart, weights_first is False: a fit then updates parameters by random
    weights before anything else.
    """

    skipped, weights_first = 0, True

    def start(self, x: np.ndarray, u: np.ndarray | None, k: int, rng: np.random.RandomState) -> object:
        """Parameters of k components to begin with."""
        raise NotImplementedError

    def distances(self, parameters: object, x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        """Costs of rows from `skipped` on in each component (rows by k)."""
        raise NotImplementedError

    def update(self, parameters: object, x: np.ndarray, u: np.ndarray | None, gamma: np.ndarray) -> object:
        """Parameters of least cost for these weights of rows from `skipped` on."""
        raise NotImplementedError

    def tables(self, parameters: object) -> list[tuple[str, np.ndarray]]:
        """The parameters as named arrays, components first."""
        raise NotImplementedError

    def restored(self, tables: dict[str, np.ndarray]) -> object:
        """Parameters from their arrays."""
        raise NotImplementedError


class Centers(Family):
    """A component is a point; costs are squared distances."""

    def start(self, x: np.ndarray, u: np.ndarray | None, k: int, rng: np.random.RandomState) -> np.ndarray:
        return x[rng.choice(len(x), k, replace=False)]

    def distances(self, parameters: np.ndarray, x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        return np.stack([((x - c) ** 2).sum(1) for c in parameters], 1)

    def update(self, parameters: np.ndarray, x: np.ndarray, u: np.ndarray | None, gamma: np.ndarray) -> np.ndarray:
        return centroids(x, gamma, parameters)

    def tables(self, parameters: np.ndarray) -> list[tuple[str, np.ndarray]]:
        return [("centers", parameters)]

    def restored(self, tables: dict[str, np.ndarray]) -> np.ndarray:
        return tables["centers"]


class Autoregressions(Family):
    """A component is a vector autoregression with a memory of its own and a contemporaneous input; costs are squared residuals.

    All memories are aligned on t: rows before the longest are outside.
    """

    weights_first = False

    def __init__(self, memories: Sequence[int]):
        self.memories, self.skipped = list(memories), max(memories)

    def _part(self, x: np.ndarray, u: np.ndarray | None, p: int) -> tuple[np.ndarray, np.ndarray | None]:
        at = self.skipped - p
        return x[at:], None if u is None else u[at:]

    def start(self, x: np.ndarray, u: np.ndarray | None, k: int, rng: np.random.RandomState) -> list[Autoregression]:
        """Weights of all 1: components of one memory start alike, and the first weights part them."""
        return self.update(None, x, u, np.ones((len(x) - self.skipped, k)))

    def distances(self, parameters: list[Autoregression], x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        out = []
        for p, model in zip(self.memories, parameters, strict=True):
            y, v = self._part(x, u, p)
            out.append((model.residuals(y, design(y, p, v, 0)) ** 2).sum(1))
        return np.stack(out, 1)

    def update(self, parameters: object, x: np.ndarray, u: np.ndarray | None, gamma: np.ndarray) -> list[Autoregression]:
        return [fit_autoregression(*self._with_input(x, u, p), 0, gamma[:, i]) for i, p in enumerate(self.memories)]

    def _with_input(self, x: np.ndarray, u: np.ndarray | None, p: int) -> tuple[np.ndarray, int, np.ndarray | None]:
        y, v = self._part(x, u, p)
        return y, p, v

    def tables(self, parameters: list[Autoregression]) -> list[tuple[str, np.ndarray]]:
        width, d = max(len(m.coefficients) for m in parameters), parameters[0].coefficients.shape[1]
        stacked, nothing = np.full((len(parameters), width, d), np.nan), np.full((d, d), np.nan)
        for i, m in enumerate(parameters):
            stacked[i, : len(m.coefficients)] = m.coefficients
        noise = [("sigma", [m.sigma for m in parameters]), ("precision", [m.precision for m in parameters])]
        return [("coefficients", stacked), *((n, np.stack([nothing if a is None else a for a in each])) for n, each in noise)]

    def restored(self, tables: dict[str, np.ndarray]) -> list[Autoregression]:
        out, k = [], len(self.memories)
        stacked, noise = (a.reshape(k, -1, a.shape[-1]) for a in (tables["coefficients"], tables["sigma"]))
        for p, c, sigma in zip(self.memories, stacked, noise, strict=True):
            c = c[~np.isnan(c).any(1)]
            d = c.shape[1]
            out.append(unpack(c, d, p, len(c) - 1 - p * d, 0, True, True, None if np.isnan(sigma).any() else sigma))
        return out


class FixedStart(Family):
    """Another family, begun at given parameters."""

    def __init__(self, family: Family, parameters: object):
        self.family, self.parameters, self.skipped = family, parameters, family.skipped

    def start(self, x: np.ndarray, u: np.ndarray | None, k: int, rng: np.random.RandomState) -> object:
        return self.parameters

    def distances(self, parameters: object, x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        return self.family.distances(parameters, x, u)

    def update(self, parameters: object, x: np.ndarray, u: np.ndarray | None, gamma: np.ndarray) -> object:
        return self.family.update(parameters, x, u, gamma)

    def tables(self, parameters: object) -> list[tuple[str, np.ndarray]]:
        return self.family.tables(parameters)

    def restored(self, tables: dict[str, np.ndarray]) -> object:
        return self.family.restored(tables)


def fit_regimes(family: Family, x: np.ndarray, u: np.ndarray | None, k: int, bound: float | None, tolerance: float = 1e-4, max_iterations: int = 500, seed: int = 0, progress: Progress | None = None) -> Regimes:
    """Alternates weights of bounded variation and parameters. Rows that the family skips have the weights of the first row after them."""
    rng, trace = np.random.RandomState(seed), Trace(progress=progress)
    parameters = family.start(x, u, k, rng)
    gamma = right_stochastic((len(x) - family.skipped, k), rng)
    for iteration in range(max_iterations):
        if iteration or not family.weights_first:
            parameters = family.update(parameters, x, u, gamma)
        distance = family.distances(parameters, x, u)
        gamma = bounded_weights(distance, bound)
        if trace.step(float((gamma * distance).sum()), tolerance, False):
            break
    return Regimes(np.vstack([np.repeat(gamma[:1], family.skipped, 0), gamma]), trace, parameters)


def regime_weights(family: Family, parameters: object, x: np.ndarray, u: np.ndarray | None, bound: float | None) -> np.ndarray:
    """Weights of new rows for fixed parameters."""
    gamma = bounded_weights(family.distances(parameters, x, u), bound)
    return np.vstack([np.repeat(gamma[:1], family.skipped, 0), gamma])
