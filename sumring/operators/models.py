"""Models trained from sufficient statistics alone, and their predictions as Column expressions.

Ridge regression, linear and quadratic discriminant analysis, Naive Bayes. Training sees a matrix of the size of the expanded
columns, on the driver; prediction stays in the JVM. A category unseen in training contributes nothing (probability 0 in Naive Bayes).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .cofactor import Cofactor


def _linear(names: list[tuple], weights: np.ndarray) -> Column:
    """sum of weight * expanded column."""
    out, maps = F.lit(0.0), {}
    for name, w in zip(names, weights, strict=True):
        if name == ("1",):
            out = out + F.lit(float(w))
        elif len(name) == 1:
            out = out + F.lit(float(w)) * F.col(name[0]).cast("double")
        else:
            maps.setdefault(name[0], []).append((name[1], float(w)))
    for c, entries in maps.items():
        table = F.create_map(*(F.lit(v) for kv in entries for v in kv))
        out = out + F.coalesce(table[F.col(c)], F.lit(0.0))
    return out


def _argmax(scores: list[Column], labels: list) -> Column:
    """Label of the greatest score, the first of equals."""
    if len(scores) == 1:
        return F.lit(labels[0])
    every = F.array(*scores)
    return F.get(F.array(*(F.lit(k) for k in labels)), (F.array_position(every, F.array_max(every)) - 1).cast("int"))


@dataclass
class Ridge:
    names: list[tuple]
    theta: np.ndarray
    variance: float

    def predict(self, noise: Column | None = None) -> Column:
        out = _linear(self.names, self.theta)
        return out if noise is None else out + F.lit(float(np.sqrt(max(0.0, self.variance)))) * noise


def ridge(value: Cofactor, label: str, lam: float = 0.0, solver: str = "closed", step: float = 0.001, max_iter: int = 10_000) -> Ridge:
    """Least squares of ``label`` on all other columns with penalty lam |theta|^2 (not on the intercept), all categories kept; of the many
    solutions of a singular system the shortest. variance: mean squared residual."""
    names, sigma = value.sigma()
    at = names.index((label,))
    rest = [i for i in range(len(names)) if i != at]
    n = max(value.n, 1.0)
    a, b, yy = sigma[np.ix_(rest, rest)] / n, sigma[rest, at] / n, sigma[at, at] / n
    penalty = lam * np.eye(len(rest))
    penalty[0, 0] = 0.0
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    core = (a + penalty) / np.outer(scale, scale)
    theta = (np.linalg.lstsq(core, b / scale, rcond=1e-12)[0] if solver == "closed" else _descend(core, b / scale, step, max_iter)) / scale
    return Ridge([names[i] for i in rest], theta, float(max(0.0, theta @ a @ theta - 2 * theta @ b + yy)))


def _descend(a: np.ndarray, b: np.ndarray, step: float, max_iter: int) -> np.ndarray:
    """Gradient descent with Barzilai-Borwein steps, halved while the cost does not fall."""
    theta = np.zeros(len(b))
    grad, cost = a @ theta - b, 0.0
    first = np.linalg.norm(grad)
    for _ in range(max_iter):
        if np.linalg.norm(grad) <= 1e-8 * (first + 1e-3):
            break
        for _ in range(500):
            new = theta - step * grad
            new_cost = new @ a @ new / 2 - new @ b
            if new_cost < cost + 1e-12 * abs(cost):  # costs near the optimum differ by rounding only
                break
            step /= 2
        else:
            break
        new_grad = a @ new - b
        d, g = new - theta, new_grad - grad
        step = float(d @ d / max(d @ g, 1e-300))
        theta, grad, cost = new, new_grad, new_cost
        if np.linalg.norm(d) < 1e-20:
            break
    return theta


def upper_triangle(values: list[float]) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    k = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + out.T - np.diag(np.diag(out))


def ridge_from_params(values: list[float], names: list[str], label: str, lam: float = 0.0) -> Ridge:
    """Ridge from the sums [n, sums, products] that plain SQL gives: the upper triangle of (1, x)'(1, x)."""
    m = upper_triangle(values)
    return ridge(Cofactor(list(names), [], m[0, 0], m[0, 1:], m[1:, 1:]), label, lam)


@dataclass
class Discriminant:
    """One row of weights (and, for QDA, a matrix) per class."""

    names: list[tuple]
    labels: list
    weights: np.ndarray
    matrices: np.ndarray | None = None

    def score_columns(self) -> list[Column]:
        out = [_linear(self.names, w) for w in self.weights]
        if self.matrices is not None:
            z = [F.lit(1.0) if n == ("1",) else F.col(n[0]).cast("double") if len(n) == 1 else (F.col(n[0]) == F.lit(n[1])).cast("double") for n in self.names]
            for k, m in enumerate(self.matrices):
                for i in range(len(z)):
                    for j in range(i, len(z)):
                        w = float(m[i, j] + (m[j, i] if i != j else 0.0))
                        if w:
                            out[k] = out[k] + F.lit(w) * z[i] * z[j]
        return out

    def predict(self) -> Column:
        return _argmax(self.score_columns(), self.labels)

    def predict_index(self) -> Column:
        """Index of the class, in the order of ``labels``."""
        return _argmax(self.score_columns(), list(range(len(self.labels))))

    def predict_at(self, cont: list[Column], positions: list[Column]) -> Column:
        """Index of the class from continuous values and, for each categorical column, the position of its category in ``names`` (null or
        outside: contributes nothing)."""
        if self.matrices is not None:
            raise ValueError("positions go with linear discriminants")
        scores = []
        for w in self.weights:
            at, out = F.array(*(F.lit(float(x)) for x in w)), F.lit(float(w[0]))
            for i, x in enumerate(cont, 1):
                out = out + F.lit(float(w[i])) * x.cast("double")
            for p in positions:
                out = out + F.when(p > len(cont), F.coalesce(F.get(at, p.cast("int")), F.lit(0.0))).otherwise(0.0)
            scores.append(out)
        return _argmax(scores, list(range(len(self.labels))))


def lda(value: Cofactor, label: str, shrinkage: float = 0.0) -> Discriminant:
    """Common within-class covariance, shrunk towards a multiple of the identity; scores are linear."""
    classes, names, sums = value.class_sums(label)
    _, sigma = value.sigma(skip=label)
    counts = sums[:, 0]
    within = sigma - (sums.T / counts) @ sums
    s = within[1:, 1:] / max(value.n, 1.0)
    p = len(s)
    s = (1 - shrinkage) * s + shrinkage * np.trace(s) / max(p, 1) * np.eye(p)
    means = sums[:, 1:] / counts[:, None]
    w = np.linalg.lstsq(s, means.T, rcond=1e-12)[0].T if p else means
    const = -0.5 * (w * means).sum(1) + np.log(counts / value.n)
    return Discriminant(names, classes, np.column_stack([const, w]))


def qda(values: dict) -> Discriminant:
    """A covariance per class by pseudo-inverse (singular values over 1e-9 alone count, in the determinant too); first categories dropped."""
    cats: dict = {}
    for v in values.values():
        for c in v.cat:
            cats[c] = sorted({*cats.get(c, []), *v.categories(c)})
    total, labels, weights, matrices, names = sum(v.n for v in values.values()), [], [], [], []
    for k, v in values.items():
        names = v.layout(True, None, cats)
        sigma = np.array([[v.entry(a, b) for b in names] for a in names])
        mean = sigma[0, 1:] / v.n
        cov = sigma[1:, 1:] / v.n - np.outer(mean, mean)
        u, s, vt = np.linalg.svd(cov)
        keep = s > 1e-9
        inv = (vt.T[:, keep] / s[keep]) @ u.T[keep]
        const = -0.5 * mean @ inv @ mean - 0.5 * np.log(s[keep]).sum() + np.log(v.n / total)
        m = np.zeros((len(names), len(names)))
        m[1:, 1:] = -0.5 * inv
        labels.append(k)
        weights.append(np.concatenate([[const], inv @ mean]))
        matrices.append(m)
    return Discriminant(names, labels, np.array(weights), np.array(matrices))


@dataclass
class NaiveBayes:
    cont: list[str]
    cat: list[str]
    labels: list
    prior: list[float]
    mean: np.ndarray
    var: np.ndarray
    freq: list[dict]

    def predict(self) -> Column:
        """Greatest prior * product of densities and frequencies, as a sum of logarithms, which does not underflow with many columns; if all are
        0 (a category unseen in every class), the first class."""
        never, scores = float("-inf"), []
        for k in range(len(self.labels)):
            p = F.lit(float(np.log(self.prior[k])))
            for i, c in enumerate(self.cont):
                v = float(self.var[k][i]) + 1e-9
                away = F.col(c).cast("double") - float(self.mean[k][i])
                p = p - away * away / (2 * v) - float(np.log(2 * np.pi * v) / 2)
            for c in self.cat:
                table = F.create_map(*(F.lit(x) for key, f in self.freq[k][c].items() for x in (key, float(np.log(f)) if f > 0 else never))) if self.freq[k][c] else None
                p = p + (F.lit(never) if table is None else F.coalesce(table[F.col(c)], F.lit(never)))
            scores.append(p)
        return _argmax(scores, self.labels)


def naive_bayes(values: dict) -> NaiveBayes:
    """From one value per class (only diagonal products are used)."""
    first, total = next(iter(values.values())), sum(v.n for v in values.values())
    mean = np.array([v.lin / v.n for v in values.values()])
    var = np.array([np.diag(v.quad) / v.n - (v.lin / v.n) ** 2 for v in values.values()])
    freq = [{c: {k: x / v.n for k, x in v.lin_cat[c].items()} for c in v.cat} for v in values.values()]
    return NaiveBayes(first.cont, first.cat, list(values), [v.n / total for v in values.values()], mean, var, freq)
