"""Many linear heads fitted in shared passes over the rows.

A pass reads the rows once and gives the loss and gradient of every head that is not settled yet; steps are made on
the driver, on weights alone. So folds, parts and thresholds multiply the arithmetic of a pass, not the passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Passes at most, pairs of steps kept, and the largest gradient of a mean loss that is settled.
PASSES, MEMORY, SETTLED = 200, 10, 1e-6
#: Rows a task has at least, and tasks at most: what a pass returns is a row for each task and head.
TASK_ROWS, TASKS = 20_000, 1024


class Head(NamedTuple):
    """Trained on rows outside fold ``fold`` and part ``part``; binary from ``threshold`` on (label above it against
    label equal to it), else over all classes."""

    fold: int
    part: int
    threshold: int | None = None


def _own(head: Head, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    mask = (rows["fold"] != head.fold) & (rows["part"] != head.part)
    if head.threshold is None:
        return mask, rows["label0"]
    return mask & (rows["label0"] >= head.threshold), (rows["label0"] > head.threshold).astype(int)


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of losses and gradient; one row of weights is a sigmoid, several are a softmax."""
    z = x @ w.T
    if len(w) == 1:
        z = z[:, 0]
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        return float((np.logaddexp(0, z) - y * z).sum()), ((p - y) @ x)[None]
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1)
    p = e / total[:, None]
    value = float((np.log(total) - z[np.arange(len(y)), y]).sum())
    p[np.arange(len(y)), y] -= 1
    return value, p.T @ x


def _passed(df: DataFrame, heads: Sequence[Head], weights: dict[int, np.ndarray] | None, width: int) -> dict[int, np.ndarray]:
    """Per head: size and second moments of its rows, or at the given weights loss and gradient; flat."""
    wanted = {i: h for i, h in enumerate(heads) if weights is None or i in weights}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = np.hstack([np.stack(batch["x"].to_numpy()), np.ones((len(batch), 1))])
            rows = {c: batch[c].to_numpy() for c in ("fold", "part", "label0")}
            for i, head in wanted.items():
                mask, y = _own(head, rows)
                if weights is None:
                    value, grad = float(mask.sum()), x[mask].T @ x[mask]
                else:
                    value, grad = _loss(x[mask], y[mask], weights[i])
                flat = np.concatenate([[value], grad.ravel()])
                sums[i] = sums[i] + flat if i in sums else flat
        if sums:  # a task without rows has no sums, and an empty column of lists has no type
            yield pd.DataFrame({"i": list(sums), "v": [s.tolist() for s in sums.values()]})

    out: dict[int, np.ndarray] = {}
    for r in df.select("x", "fold", "part", "label0").mapInPandas(run, "i int, v array<double>").collect():
        out[r["i"]] = out[r["i"]] + np.array(r["v"]) if r["i"] in out else np.array(r["v"])
    return out


class _State:
    """One head's steps: limited-memory quasi-Newton from a bound of its second derivatives, halved until the loss falls."""

    def __init__(self, n: float, moments: np.ndarray, classes: int) -> None:
        self.n, self.penalty = n, np.ones(len(moments))
        self.penalty[-1] = 0.0  # the intercept is free
        bound = moments * (0.25 if classes == 1 else 0.5) + np.diag(self.penalty + 1e-9 * max(n, 1.0))
        self.inverse = np.linalg.inv(bound)
        self.at = np.zeros((classes, len(moments)))
        self.value, self.grad, self.pairs, self.way, self.rate = np.inf, None, [], np.zeros_like(self.at), 1.0
        self.done = n == 0

    @property
    def trial(self) -> np.ndarray:
        return self.at + self.rate * self.way

    def tell(self, flat: np.ndarray) -> None:
        w = self.trial
        value = flat[0] + 0.5 * float((self.penalty * w * w).sum())
        grad = flat[1:].reshape(w.shape) + self.penalty * w
        if self.grad is not None:
            slope = float((self.grad * self.way).sum())
            if value > self.value + 1e-4 * self.rate * slope + 1e-12 * abs(self.value):
                self.rate /= 2
                self.done = self.rate < 1e-10
                return
            s, y = w - self.at, grad - self.grad
            if float((s * y).sum()) > 1e-12 * float((s * s).sum()):
                self.pairs = [*self.pairs[-MEMORY + 1 :], (s, y)]
        self.at, self.value, self.grad, self.rate = w, value, grad, 1.0
        self.done = float(np.abs(grad).max()) < SETTLED * self.n
        q, used = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = float((s * q).sum()) / float((s * y).sum())
            q -= a * y
            used.append((a, s, y))
        q = q @ self.inverse
        for a, s, y in reversed(used):
            q += s * (a - float((y * q).sum()) / float((s * y).sum()))
        self.way = -q


def fit_heads(df: DataFrame, heads: Sequence[Head], classes: int) -> list[list[tuple[list[float], float]]]:
    """``(weights, intercept)`` of each class of each head (of one alone, if binary), over ``x, label0, fold, part``.

    The penalty is half the squared weights against the sum of losses. A head without rows has zero weights, and a
    binary one an intercept that lets nothing pass. ``df`` should be stored: it is read once a pass.
    """
    first = df.select("x").first()
    if first is None:
        return [[] for _ in heads]
    width = len(first["x"]) + 1
    rows = df.coalesce(min(TASKS, max(1, df.count() // TASK_ROWS)))
    size = lambda h: classes if h.threshold is None else 1
    moments = _passed(rows, heads, None, width)
    empty = np.zeros(1 + width * width)
    states = {}
    for i, h in enumerate(heads):
        flat = moments.get(i, empty)
        states[i] = _State(flat[0], flat[1:].reshape(width, width), size(h))
    for _ in range(PASSES):
        weights = {i: s.trial for i, s in states.items() if not s.done}
        if not weights:
            break
        for i, flat in _passed(rows, heads, weights, width).items():
            states[i].tell(flat)
    out = []
    for i, h in enumerate(heads):
        w = states[i].at
        if not states[i].n and h.threshold is not None:
            w[:, -1] = -50.0
        out.append([(r[:-1].tolist(), float(r[-1])) for r in w])
    return out
