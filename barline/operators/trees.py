"""Regression trees of one series, grown level by level over all nodes and all trees at once.

Numpy inside a task: rows of a series are at most one a day. Splits are exact: every midpoint between two different
values of a feature is tried, and the one that explains most squared error wins (ties: the first feature, then the least
threshold). A tree is rows of a node table, children by number, so deeper or larger models hold shallower or smaller
ones: stopping at a depth, at nodes of too few rows, or after some trees gives what a fit with these limits gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Two values of a feature closer than this are one.
CLOSE = 1e-7
#: Gains that differ by less than this share are equal.
TIE = 1e-9
#: What an additional split of a boosted tree must gain, and the ridge on its leaves.
LEAST_GAIN, RIDGE = 1e-6, 1.0
#: Cells (features x rows) that trees grown together may have.
TOGETHER = 200_000
#: Cells from which on boosted models that wait are fitted together.
BOOSTED_TOGETHER = 100_000
COLUMNS = ("tree", "node", "depth", "feature", "threshold", "low", "high", "value", "rows", "gain")


@dataclass
class Nodes:
    """One entry per node; feature -1 and no children in a leaf. Roots are the nodes of depth 0."""

    tree: np.ndarray
    depth: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    def table(self) -> dict[str, np.ndarray]:
        return {"tree": self.tree, "node": np.arange(len(self.tree)), **{c: getattr(self, c) for c in COLUMNS[2:]}}

    @staticmethod
    def joined(parts: list[Nodes]) -> Nodes:
        shift = np.cumsum([0] + [len(p.tree) for p in parts[:-1]])
        moved = lambda c: np.concatenate([np.where(getattr(p, c) >= 0, getattr(p, c) + s, -1) for p, s in zip(parts, shift)])
        return Nodes(*[moved(c) if c in ("low", "high") else np.concatenate([getattr(p, c) for p in parts]) for c in ("tree", *COLUMNS[2:])])


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """Rows in the order of each feature. x: features x rows."""
    return np.argsort(x, axis=1, kind="stable")


def grow(
    x: np.ndarray, order: np.ndarray, weights: np.ndarray, target: np.ndarray, max_depth: int | None, min_split: int = 2, min_leaf: int = 1,
    ridge: float = 0.0, least_gain: float | None = None, first_tree: int = 0, ranks: np.ndarray | None = None,
) -> Nodes:
    """One tree per row of weights (trees x rows; rows of weight 0 are not in the tree). x: features x rows, order: sorted_rows(x)."""
    p = len(x)
    tree, row = np.nonzero(weights)
    place = np.zeros(weights.shape, np.int64)
    place[tree, row] = np.arange(len(row))
    # instances in the order of (tree, value), for each feature
    order = np.concatenate([place[t][order[(weights[t] > 0)[order]].reshape(p, -1)] for t in range(len(weights))], axis=1)
    limits = None if max_depth is None else np.full(len(weights), max_depth)
    out = _grown(x[:, row], (value_ranks(x) if ranks is None else ranks)[:, row], order, weights[tree, row].astype(float), target[row].astype(float),
                 np.bincount(tree, minlength=len(weights)), limits, min_split, min_leaf, ridge, least_gain)
    out.tree += first_tree
    return out


def _grown(
    xi: np.ndarray, ri: np.ndarray, order: np.ndarray, w: np.ndarray, t: np.ndarray, sizes: np.ndarray, limits: np.ndarray | None, min_split: int = 2,
    min_leaf: int = 1, ridge: float = 0.0, least_gain: float | None = None, apart: bool = False,
) -> Nodes:
    """One tree per entry of sizes. Instances are numbered tree by tree; xi, ri: values and their ranks, features x instances; order: instances by
    (tree, value) for each feature; limits: depth of each tree. apart: running sums begin anew with every tree, so that none depends on its companions.

    A node is a run of instances, the same in every feature's order, so sums over earlier nodes are the same for all features."""
    unit = bool((w == 1).all())
    flat = ri.ravel()
    shift = (np.arange(len(xi)) * xi.shape[1])[:, None]
    centred = np.zeros(len(w))
    out: dict[str, list] = {c: [] for c in ("tree", *COLUMNS[2:])}
    of_tree, made, depth = np.arange(len(sizes)), len(sizes), 0
    while True:
        starts = _starts(sizes)
        here = t[order[0]]
        if unit:
            total_w, total_s = sizes.astype(float), np.add.reduceat(here, starts)
        else:
            here_w = w[order[0]]
            total_w, total_s = np.add.reduceat(here_w, starts), np.add.reduceat(here_w * here, starts)
        varied = np.maximum.reduceat(here, starts) > np.minimum.reduceat(here, starts)
        n = len(sizes)
        now = {"tree": of_tree, "depth": np.full(n, depth), "feature": np.full(n, -1), "threshold": np.full(n, np.nan), "low": np.full(n, -1),
               "high": np.full(n, -1), "value": total_s / (total_w + ridge), "rows": sizes, "gain": np.zeros(n)}
        for c, v in now.items():
            out[c].append(v)
        can = varied & (sizes >= max(min_split, 2 * min_leaf, 2)) & (True if limits is None else depth < limits[of_tree])
        if not can.any():
            break
        asked = np.flatnonzero(can)
        if not can.all():
            keep = np.flatnonzero(np.repeat(can, sizes))
            order, sizes, total_w, total_s, here = np.take(order, keep, axis=1), sizes[can], total_w[can], total_s[can], here[keep]
            here_w = None if unit else here_w[keep]
            starts = _starts(sizes)
        first = order[0]
        run = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(order.shape[1]) - starts[run]  # place within the node
        mean = (total_s / total_w)[run]
        centred[first] = here - mean if unit else here_w * (here - mean)  # sums to 0 over a node, so running sums begin anew
        left = np.take(centred, order)
        if apart:
            cuts = [0, *(starts[1:][np.diff(of_tree[asked]) > 0]).tolist(), order.shape[1]]
            for a, b in zip(cuts, cuts[1:]):
                np.add.accumulate(left[:, a:b], axis=1, out=left[:, a:b])
        else:
            np.cumsum(left, axis=1, out=left)
        all_w = total_w[run]
        if unit:
            left_w = (step + 1.0)[None, :]
        else:
            left_w = np.cumsum(np.take(w, order), axis=1)
            left_w -= np.concatenate(([0.0], np.cumsum(total_w)[:-1]))[run]
        open_ = (step + 1 >= min_leaf) & (sizes[run] - step - 1 >= max(min_leaf, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            if ridge:
                left += left_w * mean
                gain = left * left
                gain /= left_w + ridge
                np.subtract(total_s[run], left, out=left)
                left *= left
                left /= all_w - left_w + ridge
                gain += left
            else:  # squared error explained, as the right side's sum is the left side's negative
                gain = np.multiply(left, left, out=left)
                gain *= all_w / (left_w * (all_w - left_w))
        rank = np.take(flat, order + shift)
        closed = np.empty(rank.shape, bool)
        closed[:, -1] = True
        np.equal(rank[:, 1:], rank[:, :-1], out=closed[:, :-1])
        closed |= ~open_
        np.putmask(gain, closed, -np.inf)
        most = np.maximum.reduceat(gain, starts, axis=1)
        best = most.max(axis=0)
        enough = best - TIE * np.maximum(1.0, np.abs(best))  # sums in another order may differ by rounding
        f = (most >= enough).argmax(axis=0)
        better = best - total_s**2 / (total_w + ridge) if ridge else best
        split = np.isfinite(best) & (True if least_gain is None else better > least_gain)
        if not split.any():
            break
        at = np.arange(order.shape[1])
        hit = np.minimum.reduceat(np.where(np.take(gain, f[run] * len(at) + at) >= enough[run], at, len(at)), starts)
        hit = np.minimum(hit, len(at) - 2)
        a, b = xi[f, order[f, hit]], xi[f, order[f, hit + 1]]
        threshold = np.where((a + b) / 2 >= b, a, (a + b) / 2)
        chosen = asked[split]
        children = made + np.arange(2 * len(chosen))
        now["feature"][chosen], now["threshold"][chosen], now["gain"][chosen] = f[split], threshold[split], better[split]
        now["low"][chosen], now["high"][chosen] = children[::2], children[1::2]
        made += len(children)
        of_tree = np.repeat(of_tree[chosen], 2)
        depth += 1
        if limits is not None and (depth >= limits[of_tree]).all():
            order = order[:1]  # children are leaves: one order tells their sums
        # a stable partition of every feature's order: low children first
        if not split.all():
            order, sizes, f, threshold = np.take(order, np.flatnonzero(split[run]), axis=1), sizes[split], f[split], threshold[split]
            starts, first = _starts(sizes), order[0]
            run = np.repeat(np.arange(len(chosen)), sizes)
            step = np.arange(order.shape[1]) - starts[run]
        goes_low = np.zeros(xi.shape[1], bool)
        goes_low[first] = xi[f[run], first] <= threshold[run]
        low_n = np.add.reduceat(goes_low[first], starts, dtype=np.int64)
        low = np.take(goes_low, order)
        parted = np.concatenate((order[low].reshape(len(order), -1), order[~low].reshape(len(order), -1)), axis=1)  # of every node: its low rows, its high ones
        before = _starts(low_n)
        place = np.where(step < low_n[run], before[run] + step, (low_n.sum() + starts - before - low_n)[run] + step)
        order = np.take(parted, place, axis=1)
        sizes = np.stack((low_n, sizes - low_n), axis=1).ravel()
    return Nodes(*[np.concatenate(out[c]) for c in ("tree", *COLUMNS[2:])])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1]))


def value_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of each feature's values; values closer than CLOSE to the one before share its rank."""
    order = sorted_rows(x)
    values = np.take_along_axis(x, order, axis=1)
    new = np.zeros(x.shape, np.int64)
    new[:, 1:] = values[:, 1:] - values[:, :-1] > CLOSE
    out = np.empty(x.shape, np.int16 if x.shape[1] < 2**15 else np.int32)
    np.put_along_axis(out, order, np.cumsum(new, axis=1).astype(out.dtype), axis=1)
    return out


def leaf_values(nodes: Nodes, x: np.ndarray, max_depth: int | None = None, min_split: int = 2) -> np.ndarray:
    """trees x rows: what each tree says, stopping at max_depth and at nodes of fewer rows than min_split. x: features x rows."""
    at = np.repeat(np.flatnonzero(nodes.depth == 0)[:, None], x.shape[1], axis=1)
    inner = (nodes.feature >= 0) & (nodes.rows >= min_split) & (True if max_depth is None else nodes.depth < max_depth)
    columns = np.arange(x.shape[1])
    while True:
        go = inner[at]
        if not go.any():
            return nodes.value[at]
        f = nodes.feature[at]
        low = x[np.maximum(f, 0), columns] <= nodes.threshold[at]
        at = np.where(go, np.where(low, nodes.low[at], nodes.high[at]), at)


def sums_of_limits(nodes: Nodes, x: np.ndarray, limits: list[tuple[int | None, int, int]]) -> list[tuple[np.ndarray, int]]:
    """For each of limits (max_depth, min_split, trees): what the trees numbered below `trees` say in sum, stopping as in leaf_values, and how many
    they are. The rows go down the trees once for all limits. x: features x rows."""
    roots = np.flatnonzero(nodes.depth == 0)
    some = [nodes.tree[roots] < most for _, _, most in limits]
    out, width = [np.zeros(x.shape[1]) for _ in limits], max(1, TOGETHER // max(1, len(roots)))
    for start in range(0, x.shape[1], width):
        here = x[:, start:start + width]
        at, columns, path = np.repeat(roots[:, None], here.shape[1], axis=1), np.arange(here.shape[1]), []
        while True:
            path.append(at)
            f = nodes.feature[at]
            go = f >= 0
            if not go.any():
                break
            low = here[np.maximum(f, 0), columns] <= nodes.threshold[at]
            at = np.where(go, np.where(low, nodes.low[at], nodes.high[at]), at)
        held = [nodes.rows[at] for at in path[:-1]]
        path = np.stack(path)
        for i, (depth, least, _) in enumerate(limits):
            down = np.zeros(at.shape, np.intp)
            for rows in held[:depth]:  # rows of a node never grow on the way down
                down += rows >= least
            stop = np.take_along_axis(path, down[None], axis=0)[0][some[i]]
            out[i][start:start + width] = nodes.value[stop].sum(axis=0)
    return [(said, int(own.sum())) for said, own in zip(out, some)]


def stopped(nodes: Nodes, max_depth: int | None, min_split: int, trees: int) -> Nodes:
    """The nodes of a fit of `trees` trees with these limits, out of a larger one."""
    inner = (nodes.feature >= 0) & (nodes.rows >= min_split) & (True if max_depth is None else nodes.depth < max_depth)
    kept = np.zeros(len(inner), bool)
    at = np.flatnonzero((nodes.depth == 0) & (nodes.tree < trees))
    while len(at):
        kept[at] = True
        at = at[inner[at]]
        at = np.concatenate((nodes.low[at], nodes.high[at]))
    number, inner = np.cumsum(kept) - 1, inner[kept]
    child = lambda c: np.where(inner, number[c[kept]], -1)
    return Nodes(nodes.tree[kept], nodes.depth[kept], np.where(inner, nodes.feature[kept], -1), np.where(inner, nodes.threshold[kept], np.nan),
                 child(nodes.low), child(nodes.high), nodes.value[kept], nodes.rows[kept], np.where(inner, nodes.gain[kept], 0.0))


def decision_tree(x: np.ndarray, y: np.ndarray, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1) -> Nodes:
    return grow(x, sorted_rows(x), np.ones((1, len(y)), np.int64), y, max_depth, min_samples_split, min_samples_leaf)


def forest(
    x: np.ndarray, y: np.ndarray, trees: range, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, seed: int = 42,
) -> Nodes:
    """Trees by number, each on as many rows as there are, drawn with replacement: tree k is the same whatever others are grown."""
    n, order, ranks, parts = len(y), sorted_rows(x), value_ranks(x), []
    at_once = max(1, TOGETHER // max(1, x.size))
    for at in range(trees.start, trees.stop, at_once):
        own = range(at, min(at + at_once, trees.stop))
        weights = np.stack([np.bincount(np.random.default_rng([seed, k]).integers(0, n, n), minlength=n) for k in own])
        parts.append(grow(x, order, weights, y, max_depth, min_samples_split, min_samples_leaf, first_tree=at, ranks=ranks))
    return Nodes.joined(parts)


def boosted(
    x: np.ndarray, y: np.ndarray, rounds: int, max_depth: int | None = 6, learning_rate: float = 0.3, subsample: float = 1.0,
    colsample_bytree: float = 1.0, seed: int = 42,
) -> Nodes:
    """Tree 0 says the mean, each later one a share of what was still missing. Squared error, ridge on leaves, rows and features drawn per
    round."""
    return boosted_together([(x, y, {"n_estimators": rounds, "max_depth": max_depth, "learning_rate": learning_rate, "subsample": subsample,
                                     "colsample_bytree": colsample_bytree})], seed)[0]


def _drawn(n: int, p: int, subsample: float, colsample_bytree: float, seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (as a mask) and features of round k."""
    draw = np.random.default_rng([seed, k])
    taken = draw.random(n) < subsample if subsample < 1 else np.ones(n, bool)
    if not taken.any():
        taken[draw.integers(n)] = True
    return taken, np.sort(draw.permutation(p)[:max(1, int(colsample_bytree * p))]) if colsample_bytree < 1 else np.arange(p)


def boosted_together(models: list[tuple[np.ndarray, np.ndarray, dict]], seed: int = 42) -> list[Nodes]:
    """Boosted models (x, y, parameters) of any series, a round of all at once: small series cost numpy calls, not work. Each model is what it is alone."""
    out: list[Nodes | None] = [None] * len(models)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (x, _, own) in enumerate(models):
        alike.setdefault((len(x), len(_drawn(1, len(x), 1.0, own["colsample_bytree"], seed, 1)[1])), []).append(i)
    for some in alike.values():
        some.sort(key=lambda i: -models[i][2]["n_estimators"])  # models that are done leave at the end
        for i, nodes in zip(some, _boosted_alike([models[i] for i in some], seed)):
            out[i] = nodes
    return out


def _boosted_alike(models: list[tuple[np.ndarray, np.ndarray, dict]], seed: int) -> list[Nodes]:
    """Models with as many features, that draw as many of them; the one with the most rounds first."""
    n = np.array([len(y) for _, y, _ in models])
    ends, p, own = np.cumsum(n), len(models[0][0]), [m for _, _, m in models]
    x, y = np.concatenate([m[0] for m in models], axis=1), np.concatenate([m[1] for m in models]).astype(float)
    ranks = np.concatenate([value_ranks(m[0]).astype(np.int32) for m in models], axis=1)
    order = np.concatenate([sorted_rows(m[0]) + start for m, start in zip(models, ends - n)], axis=1)
    base = np.array([float(m[1].mean()) for m in models])
    rounds, rate = np.array([m["n_estimators"] for m in own]), np.array([m["learning_rate"] for m in own])
    limits = np.array([2**31 if m["max_depth"] is None else m["max_depth"] for m in own])
    of_row, said = np.repeat(np.arange(len(models)), n), np.repeat(base, n)
    blank = np.full(len(models), -1)
    parts = [Nodes(np.zeros(len(models), int), np.zeros(len(models), int), blank, np.full(len(models), np.nan), blank, blank, base, n, np.zeros(len(models)))]
    of_node = [np.arange(len(models))]
    for k in range(1, rounds[0] + 1):
        going = int((rounds >= k).sum())
        rows = ends[going - 1]
        drawn: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        asked = [(int(n[i]), p, own[i]["subsample"], own[i]["colsample_bytree"]) for i in range(going)]
        for key in asked:
            if key not in drawn:
                drawn[key] = _drawn(*key, seed, k)
        taken = np.concatenate([drawn[key][0] for key in asked])
        features = np.stack([drawn[key][1] for key in asked], axis=1)
        of = features[:, of_row[:rows]] * x.shape[1]
        sorted_ = np.take(order, of + np.arange(rows))
        sorted_ = (np.cumsum(taken) - 1)[sorted_[taken[sorted_]].reshape(len(features), -1)]
        some = np.flatnonzero(taken)
        cells = of[:, some] + some
        nodes = _grown(np.take(x, cells), np.take(ranks, cells), sorted_, np.ones(len(some)), (y[:rows] - said[:rows])[some],
                       np.bincount(of_row[some], minlength=going), limits, ridge=RIDGE, least_gain=LEAST_GAIN, apart=True)
        model = nodes.tree
        nodes.feature = np.where(nodes.feature >= 0, features[nodes.feature, model], -1)
        nodes.value = nodes.value * rate[model]
        nodes.tree = np.full(len(model), k)
        parts.append(nodes)
        of_node.append(model)
        at, moving = of_row[:rows].copy(), np.arange(rows)  # roots are numbered as models are
        while len(moving):
            moving = moving[nodes.feature[at[moving]] >= 0]
            here = at[moving]
            low = np.take(x, nodes.feature[here] * x.shape[1] + moving) <= nodes.threshold[here]
            at[moving] = np.where(low, nodes.low[here], nodes.high[here])
        said[:rows] += nodes.value[at]
    whole, of_node = Nodes.joined(parts), np.concatenate(of_node)
    by_model = np.argsort(of_node, kind="stable")
    new = np.empty_like(by_model)
    new[by_model] = np.arange(len(by_model))
    cuts, out = np.searchsorted(of_node[by_model], np.arange(len(models) + 1)), []
    for a, b in zip(cuts, cuts[1:]):
        part = by_model[a:b]
        child = lambda c: np.where(getattr(whole, c)[part] >= 0, new[getattr(whole, c)[part]] - a, -1)
        out.append(Nodes(*[child(c) if c in ("low", "high") else getattr(whole, c)[part] for c in ("tree", *COLUMNS[2:])]))
    return out
