"""The cascade's two models in numpy: leaf-wise boosted trees and a residual network.

Both are fitted on all rows, in blocks and with the arrays that grow with the rows on disk, so that memory does not grow
with them (``training.on_all_pairs``), and applied to all pairs in Arrow batches (``training.Cascade``).
"""

from __future__ import annotations

import heapq
import io
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


BLOCK = 1 << 20  # rows worked on at a time
IN_MEMORY = 1 << 20  # bytes of an array that is not worth a file


def local_file():
    """A file without a name on the task's local disk, which goes with its last use."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])


def on_disk(shape: int | tuple[int, ...], dtype=float) -> np.ndarray:
    """Zeros; a large array lies in a local file."""
    if np.prod(shape) * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.zeros(shape, dtype)
    with local_file() as file:
        return np.asarray(np.memmap(file, dtype, "w+", shape=shape))


def blocks(start: int, stop: int) -> Iterator[slice]:
    return (slice(lo, min(lo + BLOCK, stop)) for lo in range(start, stop, BLOCK))


def area_under_curve(label: np.ndarray, score: np.ndarray) -> float:
    """Share of (positive, negative) pairs in the right order, ties by half; 0.5 with one class alone."""
    values, place = np.unique(score, return_inverse=True)
    pos, neg = (np.bincount(place, weights=x, minlength=len(values)) for x in (label, 1 - label))
    both = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / both) if both else 0.5


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


# --- boosted trees -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Trees end to end in flat arrays; ``left`` is the first child's place, the second follows it, and leaves lead to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int
    gains: np.ndarray  # summed over all splits of each feature

    def probability(self, x: np.ndarray, rows: int = 65_536) -> np.ndarray:
        return np.concatenate([self._block(x[i : i + rows]) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0)

    def _block(self, x: np.ndarray) -> np.ndarray:
        total, every = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                below = self.left[at]
                moved = np.where(below >= 0, below + (x[every, self.feature[at]] > self.threshold[at]), at)
                if (moved == at).all():
                    break
                at = moved
            total += self.value[at]
        return 1 / (1 + np.exp(-total))

    def pack(self) -> bytes:
        return _pack(roots=self.roots, feature=self.feature, threshold=self.threshold, left=self.left, value=self.value, scalars=np.array([self.base, self.depth]), gains=self.gains)

    @staticmethod
    def unpack(blob: bytes) -> Trees:
        z = np.load(io.BytesIO(blob))
        return Trees(z["roots"], z["feature"], z["threshold"], z["left"], z["value"], float(z["scalars"][0]), int(z["scalars"][1]), z["gains"])


JOINT_CELLS = 4096  # of a joint histogram; nodes of fewer rows are counted feature by feature


def _joint_codes(columns: list[np.ndarray], sizes: list[int]) -> list[tuple[list[int], list[int], np.ndarray]]:
    """Features in groups whose bins together have at most ``JOINT_CELLS`` cells (or one feature): the features, their
    numbers of bins, and the cell of every row.  One count of the cells gives the histograms of all features of a group."""
    groups: list[list[int]] = []
    for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        room = next((grp for grp in groups if np.prod([sizes[k] for k in grp]) * sizes[j] <= JOINT_CELLS), None)
        groups.append([j]) if room is None else room.append(j)

    def cells(grp: list[int], n: list[int]) -> np.ndarray:
        out = on_disk(len(columns[0]), np.min_scalar_type(int(np.prod(n)) - 1))
        for at in blocks(0, len(out)):
            out[at] = np.ravel_multi_index([columns[j][at].astype(np.intp) for j in grp], n)
        return out

    wide = [(grp, [sizes[j] for j in grp]) for grp in groups]
    return [(grp, n, cells(grp, n)) for grp, n in wide]


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """The distinct values at the ``bins`` - 1 inner quantiles of all rows, each the lower of two."""
    if not len(values):
        return np.zeros(0)
    ordered = on_disk(len(values))
    ordered[:] = values
    ordered.sort()
    return np.unique(ordered[np.floor(np.linspace(0, 1, bins + 1)[1:-1] * (len(values) - 1)).astype(np.intp)])


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 400, leaves: int = 63, depth: int = 8, rate: float = 0.08, features: float = 0.85, rows: float = 0.85, least: int = 20, bins: int = 128, seed: int = 42) -> Trees:
    """Gradient boosting of the logistic loss: each tree splits the leaf of the largest gain, on histograms of ``bins`` values.

    ``depth`` below 1 is unbounded.  Each tree sees shares ``rows`` and ``features`` of both; a leaf has at least ``least`` rows.
    """
    rng, (n, m) = np.random.default_rng(seed), x.shape
    depth = depth if depth > 0 else leaves
    cuts = [_cuts(x[:, j], bins) for j in range(m)]
    columns, code = [on_disk(n, np.min_scalar_type(bins)) for _ in cuts], on_disk((n, m), np.min_scalar_type(bins))
    for at in blocks(0, n):
        for j, c in enumerate(cuts):
            code[at, j] = columns[j][at] = np.searchsorted(c, x[at, j], "left")
    firsts = np.arange(m) * bins
    joint = _joint_codes(columns, [len(c) + 1 for c in cuts])
    upper = np.zeros((m, bins))
    valid = np.zeros((m, bins), bool)  # bins that have a cut after them
    for j, c in enumerate(cuts):
        upper[j, : len(c)], valid[j, : len(c)] = c, True
    share = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin, g, h, gains = on_disk(n), on_disk(n), on_disk(n), np.zeros(m)
    margin[:] = base
    place, spare = on_disk(n, np.intp), on_disk(n, np.intp)  # the rows, those of a leaf next to each other and in order
    roots, feature, threshold, left, value = [], [], [], [], []

    def halve(start: int, stop: int, first) -> int:
        """Moves the rows that ``first`` marks before the others; where these begin."""
        front, back = start, 0
        for at in blocks(start, stop):
            idx = place[at]
            low = first(idx)
            one, other = idx[low], idx[~low]
            place[front : front + len(one)], spare[back : back + len(other)] = one, other
            front, back = front + len(one), back + len(other)
        place[front:stop] = spare[:back]
        return front

    def histogram(start: int, stop: int) -> np.ndarray:
        out = np.zeros((3, m, bins))
        if stop - start < JOINT_CELLS:
            idx = place[start:stop]
            flat = (code[idx] + firsts).ravel()
            return np.stack([np.bincount(flat, np.repeat(w[idx], m), m * bins) for w in (g, h)] + [np.bincount(flat, minlength=m * bins).astype(float)]).reshape(out.shape)
        for at in blocks(start, stop):
            idx = place[at]
            own = g[idx], h[idx], None
            for members, sizes, codes in joint:
                cells = codes[idx].astype(np.intp)
                for i, w in enumerate(own):
                    table = np.bincount(cells, w, int(np.prod(sizes))).reshape(sizes)
                    for axis, j in enumerate(members):
                        out[i, j, : sizes[axis]] += table.sum(axis=tuple(k for k in range(len(sizes)) if k != axis))
        return out

    def best_split(hist: np.ndarray, usable: np.ndarray):
        total = hist[:, 0].sum(axis=1)
        a = np.cumsum(hist, axis=2)
        b = total[:, None, None] - a
        ok = usable[:, None] & valid & (a[2] >= least) & (b[2] >= least) & (a[1] > 1e-3) & (b[1] > 1e-3)
        gain = np.where(ok, a[0] ** 2 / np.maximum(a[1], 1e-9) + b[0] ** 2 / np.maximum(b[1], 1e-9) - total[0] ** 2 / max(total[1], 1e-9), -1.0)
        at = int(gain.argmax())
        return float(gain.flat[at]), at // bins, at % bins

    for _ in range(rounds if 0 < y.sum() < n else 0):
        for at in blocks(0, n):
            p = 1 / (1 + np.exp(-margin[at]))
            g[at], h[at], place[at] = p - y[at], p * (1 - p), np.arange(at.start, at.stop)
        drawn = halve(0, n, lambda idx: rng.random(len(idx)) < rows)
        usable = np.zeros(m, bool)
        usable[rng.permutation(m)[: max(1, round(features * m))]] = True
        roots.append(len(feature))
        held: dict[int, tuple[tuple[int, int], tuple[int, int]]] = {}  # of each leaf: the rows drawn, and the others, which only follow

        def leaf(members: tuple[int, int], others: tuple[int, int]) -> int:
            for v, x in ((feature, 0), (threshold, 0.0), (left, -1), (value, 0.0)):
                v.append(x)
            held[len(feature) - 1] = members, others
            return len(feature) - 1

        queue: list = []

        def offer(node: int, hist: np.ndarray, level: int) -> None:
            gain, j, b = best_split(hist, usable)
            if gain > 1e-9:
                heapq.heappush(queue, (-gain, node, j, b, hist, level))

        def open_(members: tuple[int, int], level: int) -> bool:
            return level < depth and members[1] - members[0] >= 2 * least

        root = leaf((0, drawn), (drawn, n))
        if open_(held[root][0], 0):
            offer(root, histogram(0, drawn), 0)
        grown = 1
        while queue and grown < leaves:
            lost, node, j, b, hist, level = heapq.heappop(queue)
            feature[node], threshold[node], left[node] = j, upper[j, b], len(feature)
            gains[j] -= lost
            halves = [((start, middle), (middle, stop)) for start, stop in held.pop(node) for middle in [halve(start, stop, lambda idx: columns[j][idx] <= b)]]
            children = [leaf(halves[0][side], halves[1][side]) for side in (0, 1)]
            grown += 1
            small, large = sorted((0, 1), key=lambda side: halves[0][side][1] - halves[0][side][0])
            if grown < leaves and open_(halves[0][large], level + 1):
                hists = [None, None]
                hists[small] = histogram(*halves[0][small])
                hists[large] = hist - hists[small]
                for side in (0, 1):
                    if open_(halves[0][side], level + 1):
                        offer(children[side], hists[side], level + 1)
        for node, (members, others) in held.items():
            sums = [sum(float(w[place[at]].sum()) for at in blocks(*members)) for w in (g, h)]
            value[node] = float(-rate * sums[0] / max(sums[1], 1e-9))
            for at in (*blocks(*members), *blocks(*others)):
                margin[place[at]] += value[node]
    return Trees(*(np.array(v, t) for v, t in ((roots, np.int64), (feature, np.int64), (threshold, float), (left, np.int64), (value, float))), base, depth, gains)


# --- residual network --------------------------------------------------------------------------------------------------

BLOCKS = 2
NORM_EPSILON, NORM_MOMENTUM = 1e-3, 0.99


@dataclass(frozen=True)
class Network:
    """Dense and normalised input layer, residual blocks, a narrower layer, one logit; ``weights`` by name."""

    weights: dict

    def probability(self, x: np.ndarray, rows: int = 16_384) -> np.ndarray:
        return np.concatenate([_forward(self.weights, x[i : i + rows], None)[0] for i in range(0, len(x), rows)]) if len(x) else np.zeros(0)

    def pack(self) -> bytes:
        return _pack(**self.weights)

    @staticmethod
    def unpack(blob: bytes) -> Network:
        z = np.load(io.BytesIO(blob))
        return Network({k: z[k] for k in z.files})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(w: dict, x: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, list]:
    """Probabilities, and what the way back needs; with ``rng`` as in training: batch moments (kept in ``w``) and dropout."""
    tape: list = []

    def swish_layer(name: str, v: np.ndarray) -> np.ndarray:
        z = v @ w[f"{name}_w"] + w[f"{name}_b"]
        s = _sigmoid(z)
        tape.append(("swish", name, v, z, s))
        return z * s

    def normalise(name: str, v: np.ndarray) -> np.ndarray:
        mean, var = (v.mean(axis=0), v.var(axis=0)) if rng is not None else (w[f"{name}_mean"], w[f"{name}_var"])
        if rng is not None:
            for k, now in (("mean", mean), ("var", var)):
                w[f"{name}_{k}"] = NORM_MOMENTUM * w[f"{name}_{k}"] + (1 - NORM_MOMENTUM) * now
        spread = 1 / np.sqrt(var + NORM_EPSILON)
        unit = (v - mean) * spread
        tape.append(("norm", name, unit, spread))
        return w[f"{name}_scale"] * unit + w[f"{name}_shift"]

    def dropout(v: np.ndarray, share: float) -> np.ndarray:
        if rng is None:
            return v
        keep = ((rng.random(v.shape) >= share) / (1 - share)).astype(v.dtype)
        tape.append(("drop", keep))
        return v * keep

    v = normalise("first", swish_layer("in", (x - w["centre"]) / w["spread"]))
    for i in range(BLOCKS):
        tape.append(("fork",))
        inner = swish_layer(f"block{i}b", dropout(normalise(f"block{i}", swish_layer(f"block{i}a", v)), 0.2))
        tape.append(("join",))
        v = v + inner
    v = dropout(swish_layer("narrow", v), 0.1)
    tape.append(("logit", v))
    return _sigmoid(v @ w["out_w"] + w["out_b"])[:, 0], tape


def _backward(w: dict, tape: list, off: np.ndarray) -> dict:
    """Gradients of the mean log loss; ``off`` is probability less label."""
    grads, shortcut = {}, []
    d = off[:, None] / len(off)
    for kind, *saved in reversed(tape):
        if kind == "logit":
            grads["out_w"], grads["out_b"] = saved[0].T @ d, d.sum(axis=0)
            d = d @ w["out_w"].T
        elif kind == "drop":
            d = d * saved[0]
        elif kind == "norm":
            name, unit, spread = saved
            grads[f"{name}_scale"], grads[f"{name}_shift"] = (d * unit).sum(axis=0), d.sum(axis=0)
            d = d * w[f"{name}_scale"]
            d = spread * (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0))
        elif kind == "swish":
            name, v, z, s = saved
            d = d * (s + z * s * (1 - s))
            grads[f"{name}_w"], grads[f"{name}_b"] = v.T @ d, d.sum(axis=0)
            d = d @ w[f"{name}_w"].T
        elif kind == "join":
            shortcut.append(d)
        else:
            d = d + shortcut.pop()
    return grads


def fit_network(x: np.ndarray, y: np.ndarray, val_x: np.ndarray, val_y: np.ndarray, width: int = 128, narrow: int = 64, epochs: int = 6, batch: int = 512, rate: float = 0.002, patience: int = 3, least_gain: float = 5e-4, seed: int = 42) -> Network:
    """Adam on the log loss, in the precision of ``x``, whose rows are in random order: each epoch mixes them within blocks, and the blocks.

    Stops when the area under the curve of the held-out rows has not grown for ``patience`` epochs, halves the rate after
    each that did not grow, and keeps the best epoch's weights.
    """
    rng, m = np.random.default_rng(seed), x.shape[1]
    centre = sum((x[at].sum(axis=0, dtype=float) for at in blocks(0, len(x))), np.zeros(m)) / max(len(x), 1)
    spread = np.sqrt(sum((((x[at] - centre) ** 2).sum(axis=0) for at in blocks(0, len(x))), np.zeros(m)) / max(len(x), 1))
    w = {"centre": centre, "spread": np.where(spread > 0, spread, 1.0)}
    shapes = [("in", m, width)] + [(f"block{i}{s}", width, width) for i in range(BLOCKS) for s in "ab"] + [("narrow", width, narrow), ("out", narrow, 1)]
    for name, a, b in shapes:
        reach = np.sqrt(6 / (a + b))
        w[f"{name}_w"], w[f"{name}_b"] = rng.uniform(-reach, reach, (a, b)), np.zeros(b)
    for name in ["first"] + [f"block{i}" for i in range(BLOCKS)]:
        w |= {f"{name}_scale": np.ones(width), f"{name}_shift": np.zeros(width), f"{name}_mean": np.zeros(width), f"{name}_var": np.ones(width)}
    w = {k: v.astype(x.dtype) for k, v in w.items()}
    first, second, steps = {}, {}, 0
    best, top, idle = dict(w), -1.0, 0
    for _ in range(epochs if len(x) else 0):
        parts = list(blocks(0, len(x)))
        for part in rng.permutation(len(parts)) if len(parts) > 1 else range(len(parts)):
            order = parts[part].start + rng.permutation(parts[part].stop - parts[part].start)
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                p, tape = _forward(w, x[rows], rng)
                steps += 1
                for k, g in _backward(w, tape, p - y[rows]).items():
                    first[k] = 0.9 * first.get(k, 0.0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0.0) + 0.001 * g * g
                    w[k] = w[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-7)
        now = area_under_curve(val_y, Network(w).probability(val_x))
        if now > top + least_gain:
            best, top, idle = dict(w), now, 0
        else:
            idle, rate = idle + 1, rate / 2
            if idle >= patience:
                break
    return Network(best)
