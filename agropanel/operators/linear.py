"""Ridge and elastic net solved from ``Moments``: the rows are read once for any number of fits.

Features are standardised by their mean and population deviation, the label is centred.
A constant feature gets no weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from agropanel.operators.moments import Moments


class NotConverged(RuntimeError):
    """The duality gap stayed above the tolerance."""


@dataclass(frozen=True)
class Problem:
    """Moments of ``(features, label)`` in standardised units, per row: ``gram`` of the features, ``cross`` with the label."""

    n: int
    mean: np.ndarray
    deviation: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    label_mean: float
    label_variance: float

    @staticmethod
    def of(m: Moments) -> Problem:
        covariance = m.scatter / m.n
        spread = np.sqrt(np.diag(covariance)[:-1])
        # What is left of a constant by rounding is no spread.
        constant = spread <= 1e-12 * np.maximum(np.abs(m.mean[:-1]), 1e-300)
        deviation = np.where(constant, 1.0, spread)
        gram = covariance[:-1, :-1] / np.outer(deviation, deviation)
        cross = covariance[:-1, -1] / deviation
        gram[constant, :], gram[:, constant], cross[constant] = 0.0, 0.0, 0.0
        return Problem(m.n, m.mean[:-1], deviation, gram, cross, float(m.mean[-1]), float(covariance[-1, -1]))

    def raw(self, weights: np.ndarray, fit_intercept: bool = True) -> tuple[np.ndarray, float]:
        """Weights of the features as they are, and the intercept."""
        own = weights / self.deviation
        return own, (self.label_mean if fit_intercept else 0.0) - float(own @ self.mean)

    def gap(self, weights: np.ndarray, alpha: float, ratio: float, centred: bool = True) -> float:
        """Duality gap per row of ``|y - Xw|^2 / 2 + alpha (ratio |w|_1 + (1 - ratio) |w|^2 / 2)``.

        The residual, scaled down until no feature's slope exceeds the L1 penalty, is a
        point of the dual problem; what lies between both values bounds the error.
        """
        l1, l2 = alpha * ratio, alpha * (1 - ratio)
        energy = self.label_variance + (0.0 if centred else self.label_mean**2)
        fitted = self.gram @ weights
        residual = energy - 2 * self.cross @ weights + weights @ fitted  # |r|^2 / n
        with_label = energy - self.cross @ weights  # r.y / n
        slope = np.abs(self.cross - fitted - l2 * weights).max(initial=0.0)
        scale = 1.0 if slope <= l1 else l1 / slope
        squares = weights @ weights
        primal = residual / 2 + l1 * np.abs(weights).sum() + l2 * squares / 2
        dual = scale * with_label - scale**2 * (residual + l2 * squares) / 2
        return float(primal - dual)


def ridge(problem: Problem, alpha: float) -> np.ndarray:
    """Weights of the least ``|y - Xw|^2 + alpha |w|^2``; of several, the shortest."""
    system = problem.gram + np.eye(len(problem.cross)) * (alpha / problem.n)
    return np.linalg.lstsq(system, problem.cross, rcond=None)[0] if alpha == 0 else np.linalg.solve(system, problem.cross)


def elastic_net(
    problem: Problem, alpha: float, ratio: float, start: np.ndarray | None = None, max_iter: int = 2000, tol: float = 1e-4, centred: bool = True,
) -> np.ndarray:
    """Weights of the least ``|y - Xw|^2 / 2n + alpha (ratio |w|_1 + (1 - ratio) |w|^2 / 2)``.

    Coordinates are set to their best value in turn, from the Gram matrix alone. After
    a round over all, rounds go over those that are not zero until these rest; then all
    are tried again. It ends once the duality gap is within ``tol`` of the label's
    sum of squares, and raises ``NotConverged`` after ``max_iter`` rounds. Without L1
    part it is a ridge.
    """
    if ratio == 0:  # no L1 part: the dual has no bound to offer, and none is needed
        return ridge(problem, alpha * problem.n)
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    own = np.diag(problem.gram).copy()
    usable = np.flatnonzero(own > 0)
    weights = np.zeros(len(own)) if start is None else start.copy()
    slopes = problem.cross - problem.gram @ weights
    limit = tol * (problem.label_variance + (0.0 if centred else problem.label_mean**2))

    def once(places: Sequence[int]) -> float:
        moved = 0.0
        for j in places:
            pull = slopes[j] + own[j] * weights[j]
            best = np.sign(pull) * max(abs(pull) - l1, 0.0) / (own[j] + l2)
            change = best - weights[j]
            if change:
                weights[j] = best
                slopes[:] -= change * problem.gram[:, j]
                moved = max(moved, abs(change))
        return moved

    rounds = 0
    while rounds < max_iter:
        moved = once(usable)
        rounds += 1
        if problem.gap(weights, alpha, ratio, centred) <= limit:
            return weights
        still = moved * 1e-3
        while rounds < max_iter and moved > still:
            moved = once(np.flatnonzero(weights))
            rounds += 1
        slopes = problem.cross - problem.gram @ weights  # sums of small steps are not left to drift
    if problem.gap(weights, alpha, ratio, centred) <= limit:
        return weights
    raise NotConverged(f"gap {problem.gap(weights, alpha, ratio, centred):.3g} above {limit:.3g} after {max_iter} rounds at alpha {alpha}, l1_ratio {ratio}")


def path(problem: Problem, alphas: Sequence[float], ratio: float, **options) -> dict[float, np.ndarray]:
    """Elastic nets from the strongest penalty to the weakest, each starting from the one before."""
    out, weights = {}, None
    for alpha in sorted(set(alphas), reverse=True):
        weights = out[alpha] = elastic_net(problem, alpha, ratio, weights, **options)
    return out
