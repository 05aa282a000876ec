"""Many small convex problems fitted at once over one table.

Rows are packed into dense blocks that stay in the executors (spilled or read again where
they are lost).  A pass gives the loss and gradient of every problem at its own trial
point: tasks add up their blocks and a tree adds up the tasks, so the driver holds a few
vectors of (problems x coefficients) and never a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; coefficients of all problems together, eight bytes each, of which the driver keeps some twenty copies.
ROWS, COEFFICIENTS = 2048, 4_000_000
#: Steps whose curvature is remembered.
MEMORY = 8

Partial = tuple[np.ndarray, np.ndarray]


class Block(NamedTuple):
    x: np.ndarray  # rows x (features + 1), the last column is 1
    label: np.ndarray
    fold: np.ndarray


def blocks(rows: DataFrame) -> RDD:
    """Dense blocks of (label, fold, features)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def cut(least: int) -> Iterator[pd.DataFrame]:
            nonlocal held, n
            whole = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
            lo = 0
            while len(whole) - lo >= least:
                part = whole.iloc[lo : lo + ROWS]
                x = np.vstack(part["features"].to_numpy()).astype(np.float64)
                numbers = part[["label", "fold"]].to_numpy(dtype=np.int64)
                yield pd.DataFrame({"n": [len(part)], "x": [x.tobytes()], "numbers": [numbers.tobytes()]})
                lo += ROWS
            held = [whole.iloc[lo:]] if lo < len(whole) else []
            n = max(len(whole) - lo, 0)

        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= ROWS:
                yield from cut(ROWS)
        yield from cut(1)

    def unpack(row) -> Block:
        numbers = np.frombuffer(row.numbers, dtype=np.int64).reshape(row.n, 2)
        x = np.frombuffer(row.x).reshape(row.n, -1)
        return Block(np.hstack([x, np.ones((row.n, 1))]), numbers[:, 0], numbers[:, 1])

    given = rows.select(F.col("label").cast("bigint").alias("label"), F.col("fold").cast("bigint").alias("fold"), "features")
    packed = given.mapInPandas(pack, "n int, x binary, numbers binary")
    return packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _add(a: Partial, b: Partial) -> Partial:
    return a[0] + b[0], a[1] + b[1]


def total(data: RDD, partial: Callable[[Block], Partial], shape: tuple[int, ...]) -> Partial:
    """Sum of ``partial`` over all blocks, by a tree."""

    def of_task(found: Iterator[Block]) -> Iterator[Partial]:
        loss, grad = np.zeros(shape[0]), np.zeros(shape)
        for block in found:
            more = partial(block)
            loss += more[0]
            grad += more[1]
        yield loss, grad

    return data.mapPartitions(of_task).treeReduce(_add)


def minimise_together(
    evaluate: Callable[[np.ndarray, np.ndarray], Partial], start: np.ndarray, iterations: int, tolerance: float = 1e-6
) -> tuple[np.ndarray, np.ndarray]:
    """(points, iterations used) by limited-memory BFGS for each row of ``start``.

    ``evaluate(points, active)`` gives the losses and gradients of all problems in one
    pass.  Every problem has its own direction, step length and end; a pass serves those
    that still look for a step as well as those that take one."""
    w, n = start.copy(), len(start)
    flat = lambda a: a.reshape(n, -1)
    active = np.ones(n, dtype=bool)
    loss, grad = evaluate(w, active)
    used, step = np.zeros(n, dtype=int), np.ones(n)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    direction = np.zeros_like(flat(w))

    def aim(k: int) -> None:
        q, kept = flat(grad)[k].copy(), []
        for s, y in reversed(past[k]):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        if past[k]:
            s, y = past[k][-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past[k], reversed(kept), strict=True):
            q += s * (a - y @ q / (s @ y))
        direction[k] = -q
        if -q @ flat(grad)[k] >= 0:  # not downhill: start again from the gradient
            past[k].clear()
            direction[k] = -flat(grad)[k]
        step[k] = 1.0 if past[k] else min(1.0, 1.0 / max(np.abs(direction[k]).sum(), 1e-300))

    def finish(k: int, gain: float) -> None:
        small = np.abs(flat(grad)[k]).max() <= tolerance * max(1.0, abs(loss[k]))
        active[k] = not (small or used[k] >= iterations or gain <= 1e-12 * max(1.0, abs(loss[k])))

    for k in range(n):
        finish(k, np.inf)
        aim(k)
    while active.any():
        trial = flat(w) + np.where(active, step, 0.0)[:, None] * direction
        new_loss, new_grad = evaluate(trial.reshape(w.shape), active)
        for k in np.flatnonzero(active):
            slope = flat(grad)[k] @ direction[k]
            if not new_loss[k] <= loss[k] + 1e-4 * step[k] * slope:
                step[k] /= 2
                active[k] = step[k] > 1e-20
                continue
            moved, turned = trial[k] - flat(w)[k], flat(new_grad)[k] - flat(grad)[k]
            if moved @ turned > 1e-12 * (turned @ turned):
                past[k] = [*past[k], (moved, turned)][-MEMORY:]
            gain = loss[k] - new_loss[k]
            flat(w)[k], loss[k], flat(grad)[k] = trial[k], new_loss[k], flat(new_grad)[k]
            used[k] += 1
            finish(k, gain)
            aim(k)
    return w, used


def _check(shape: tuple[int, ...]) -> None:
    if np.prod(shape) > COEFFICIENTS:
        raise ValueError(f"{shape} coefficients are more than {COEFFICIENTS} together")


def fit_softmax_folds(rows: DataFrame, classes: int, folds: int, c: float = 1.0, iterations: int = 100) -> np.ndarray:
    """(folds + 1) x (features + 1) x classes: multinomial logistic regressions with an L2
    penalty (the intercept is free), number k without the rows of fold k and the last with all.

    All are trained together: one pass, one tree sum of gradients keyed by fold."""
    data = blocks(rows)
    first = data.take(1)
    width = first[0].x.shape[1] if first else 1
    shape = (folds + 1, width, classes)
    _check(shape)

    def evaluate(points: np.ndarray, active: np.ndarray) -> Partial:
        def partial(block: Block) -> Partial:
            loss, grad = np.zeros(folds + 1), np.zeros(shape)
            for k in np.flatnonzero(active):
                mine = block.fold != k
                x, label = block.x[mine], block.label[mine]
                if not len(x):
                    continue
                scores = x @ points[k]
                scores -= scores.max(axis=1, keepdims=True)
                powers = np.exp(scores)
                sums = powers.sum(axis=1)
                at = np.arange(len(x)), label
                loss[k] = c * (np.log(sums) - scores[at]).sum()
                powers /= sums[:, None]
                powers[at] -= 1
                grad[k] = c * (x.T @ powers)
            return loss, grad

        loss, grad = total(data, partial, shape)
        penal = points.copy()
        penal[:, -1, :] = 0
        return loss + (penal**2).sum(axis=(1, 2)) / 2, grad + penal

    try:
        return minimise_together(evaluate, np.zeros(shape), iterations)[0] if first else np.zeros(shape)
    finally:
        data.unpersist()


def class_pairs(classes: int) -> np.ndarray:
    """(0, 1), (0, 2) ... (classes - 2, classes - 1)."""
    return np.stack(np.triu_indices(classes, 1), axis=1)


def fit_pairs(rows: DataFrame, classes: int, c: float = 1.0, iterations: int = 200) -> np.ndarray:
    """pairs x (features + 1): a support vector machine (squared hinge) for every two
    classes, each with the rows of its two classes only; positive values speak for the first.

    All pairs are trained together: a block's rows of a class add to the gradients of
    the pairs that class is in, keyed by pair, and one tree sum serves them all."""
    data = blocks(rows.withColumn("fold", F.lit(0)))
    first = data.take(1)
    width = first[0].x.shape[1] if first else 1
    pairs = class_pairs(classes)
    shape = (len(pairs), width)
    _check(shape)

    def evaluate(points: np.ndarray, active: np.ndarray) -> Partial:
        def partial(block: Block) -> Partial:
            loss, grad = np.zeros(len(pairs)), np.zeros(shape)
            for label in np.unique(block.label):
                x = block.x[block.label == label]
                mine = np.flatnonzero((pairs == label).any(axis=1) & active)
                sign = np.where(pairs[mine, 0] == label, 1.0, -1.0)
                short = np.maximum(0.0, 1.0 - (x @ points[mine].T) * sign)
                loss[mine] += c * (short**2).sum(axis=0)
                grad[mine] += (-2 * c * sign)[:, None] * (short.T @ x)
            return loss, grad

        loss, grad = total(data, partial, shape)
        penal = points.copy()
        penal[:, -1] = 0
        return loss + (penal**2).sum(axis=1) / 2, grad + penal

    try:
        if not first or not len(pairs):
            return np.zeros(shape)
        return minimise_together(evaluate, np.zeros(shape), iterations, 1e-4)[0]
    finally:
        data.unpersist()


def pair_votes(decisions: np.ndarray, classes: int) -> np.ndarray:
    """The class with most votes of its pairs, ties to the smallest, of each row of decisions."""
    pairs = class_pairs(classes)
    winner = np.where(decisions > 0, pairs[:, 0], pairs[:, 1])
    places = winner + classes * np.arange(len(decisions))[:, None]
    return np.bincount(places.ravel(), minlength=classes * len(decisions)).reshape(-1, classes).argmax(axis=1)
