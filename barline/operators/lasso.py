"""Lasso of every series from moments: one pass over the rows, then coordinate descent on matrices as wide as the features.

Moments of (1, features, target) are sums of products, gathered per series and block of rows in the tasks that read the rows, and added. Expanding
folds are sums of the first blocks; errors on a block follow from its moments too. Minimised is the mean squared error halved
plus alpha times the sum of absolute coefficients, with a free intercept and features as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.sources.scratch import stage

TOLERANCE = 1e-9


def moments(rows: DataFrame, features: Sequence[str], block: Column) -> DataFrame:
    """symbol, block, moments: the symmetric matrix of products of (1, features, target) as bytes of doubles, summed over the rows."""
    names = ["one", *features, "target"]
    width = len(names)
    thin = rows.select("symbol", block.cast("int").alias("block"), F.lit(1.0).alias("one"), *[
        F.col(f"`{c}`").cast("double").alias(c) for c in (*features, "target")])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, codes = np.unique(batch.column("symbol").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            blocks = batch.column("block").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            keys = np.stack((codes, blocks), axis=1)
            groups, member = np.unique(keys, axis=0, return_inverse=True)
            sums = [x[own].T @ x[own] for own in (member.ravel() == k for k in range(len(groups)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(symbols[groups[:, 0]]), pa.array(groups[:, 1].astype(np.int32)), pa.array([m.tobytes() for m in sums], pa.binary())],
                ["symbol", "block", "moments"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width * width)
        for data in table.column("moments"):
            total += np.frombuffer(data.as_py())
        return pa.table({"symbol": table.column("symbol").slice(0, 1), "block": table.column("block").slice(0, 1), "moments": pa.array([total.tobytes()], pa.binary())})

    schema = "symbol string, block int, moments binary"
    return thin.mapInArrow(partial, schema).groupBy("symbol", "block").applyInArrow(add, schema)


def unpacked(data: bytes, chosen: Sequence[int] | None = None) -> np.ndarray:
    """The matrix, of the chosen features only (numbers from 0) between one and target."""
    whole = np.frombuffer(data)
    width = int(round(len(whole) ** 0.5))
    whole = whole.reshape(width, width)
    if chosen is None:
        return whole
    at = [0, *[c + 1 for c in chosen], width - 1]
    return whole[np.ix_(at, at)]


def descend(sums: np.ndarray, alphas: np.ndarray, max_iter: int = 1000, tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (alphas x features) and intercepts of the lasso over rows with these moments, for all alphas at once.

    Ends after max_iter sweeps, or when no coefficient moves more than `tol` of the largest one."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    centred = sums[1:, 1:] / n - np.outer(mean, mean)
    gram, pull = centred[:-1, :-1], centred[:-1, -1]
    size = np.diag(gram).copy()
    usable = np.flatnonzero(size > 1e-12 * np.maximum(1.0, np.abs(mean[:-1])) ** 2)
    alphas = np.asarray(alphas, float)
    w = np.zeros((len(alphas), len(pull)))
    rest = np.tile(pull, (len(alphas), 1))  # correlation of each feature with what is still unexplained
    for _ in range(max_iter):
        moved = 0.0
        for j in usable:
            free = rest[:, j] + size[j] * w[:, j]
            new = np.sign(free) * np.maximum(np.abs(free) - alphas, 0) / size[j]
            change = new - w[:, j]
            if change.any():
                rest -= change[:, None] * gram[j][None, :]
                w[:, j] = new
                moved = max(moved, float(np.abs(change).max()))
        if moved <= tol * max(float(np.abs(w).max(initial=0.0)), 1e-300):
            break
    return w, mean[-1] - w @ mean[:-1]


def descend_together(problems: Sequence[tuple[np.ndarray, float, int, float]]) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept of each of many small problems (moments, alpha, max_iter, tol), a sweep of all at once: each is what descend says."""
    out: list[tuple[np.ndarray, float] | None] = [None] * len(problems)
    alike: dict[int, list[int]] = {}
    for i, (sums, alpha, most, tol) in enumerate(problems):
        if np.isfinite(sums).all():
            alike.setdefault(len(sums), []).append(i)
        else:
            w, b = descend(sums, [alpha], most, tol)
            out[i] = w[0], b[0]
    for some in alike.values():
        sums = np.stack([problems[i][0] for i in some])
        alphas, most, tol = (np.array([problems[i][k] for i in some]) for k in (1, 2, 3))
        means = sums[:, 0, 1:] / sums[:, 0, :1]
        centred = sums[:, 1:, 1:] / sums[:, :1, :1] - means[:, :, None] * means[:, None, :]
        gram, rest = centred[:, :-1, :-1], centred[:, :-1, -1].copy()
        size = np.einsum("kii->ki", gram).copy()
        usable = size > 1e-12 * np.maximum(1.0, np.abs(means[:, :-1])) ** 2
        w, left, sweep = np.zeros(rest.shape), np.arange(len(some)), 0
        size = np.where(usable, size, 1.0)
        while len(left):
            sweep += 1
            moved = np.zeros(len(left))
            for j in range(w.shape[1]):
                free = rest[:, j] + size[:, j] * w[:, j]
                new = np.sign(free) * np.maximum(np.abs(free) - alphas, 0) / size[:, j]
                change = np.where(usable[:, j], new - w[:, j], 0.0)
                rest -= change[:, None] * gram[:, j]
                w[:, j] = np.where(usable[:, j], new, 0.0)
                np.maximum(moved, np.abs(change), out=moved)
            done = (moved <= tol * np.maximum(np.abs(w).max(axis=1, initial=0.0), 1e-300)) | (sweep >= most)
            if done.any():
                for k in np.flatnonzero(done):
                    mean = means[left[k]]
                    out[some[left[k]]] = w[k].copy(), (mean[-1] - w[k:k + 1] @ mean[:-1])[0]
                alphas, most, tol, gram, rest, size, usable, w, left = (a[~done] for a in (alphas, most, tol, gram, rest, size, usable, w, left))
    return out


def squared_errors(sums: np.ndarray, w: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Mean squared error of each model over the rows with these moments."""
    ask = np.concatenate((intercepts[:, None], w, -np.ones((len(w), 1))), axis=1)
    return np.maximum(np.einsum("ai,ij,aj->a", ask, sums, ask), 0) / sums[0, 0]


def fold_block(folds: int) -> Column:
    """Blocks of a series with columns pos and n: 0 before the first test block, then 1 to `folds`."""
    size = F.floor(F.col("n") / (folds + 1))
    start = F.col("n") - F.lit(folds) * size
    return F.when(F.col("pos") <= start, 0).otherwise(F.floor((F.col("pos") - start - 1) / size) + 1).cast("int")


def fold_errors(blocks: dict[int, np.ndarray], folds: int, alphas: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """alphas x folds: mean squared error on block i + 1 of the models fitted on all blocks before it."""
    out, seen = np.full((len(alphas), folds), np.nan), blocks.get(0)
    for i in range(folds):
        test = blocks.get(i + 1)
        if seen is not None and seen[0, 0] > 0 and test is not None:
            out[:, i] = squared_errors(test, *descend(seen, alphas, max_iter, tol))
        seen = test if seen is None else seen + test if test is not None else seen
    return out


def staged_moments(train: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    """Moments of train rows by fold block; folds 0: one block."""
    return stage(moments(train, features, fold_block(folds) if folds else F.lit(0)), "moments")
