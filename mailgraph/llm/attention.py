"""A small causal self-attention model over subword ids in numpy, float32: one head, one layer, trained with Adam.

Every id has an embedding of its own. The next id is predicted in two softmax steps, both from the attention's output: its class, then the id among the class's
members; so each id has a probability of its own, and all of them add up to one. All functions work on batches of windows (windows x places).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 16
PLACES = 24
#: places of a later window that only serve as context
OVERLAP = 4
FINE = 49_408
COARSE = 32
RATE = 0.02
#: rate of the members' vectors (Adagrad)
INNER_RATE = 0.1
BATCH = 512
_SEEN = np.tril(np.ones((PLACES, PLACES), dtype=np.float32))
#: ``inner`` has a row for each id, in the order of ``Members``; its last column is a bias
SHAPES = {"embed": (FINE, WIDTH), "place": (PLACES, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "mix": (WIDTH, WIDTH),
          "out": (WIDTH, COARSE), "bias": (COARSE,), "inner": (FINE, WIDTH + 1)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

Weights = dict[str, np.ndarray]


def unpack(flat: np.ndarray) -> Weights:
    weights, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        weights[name] = np.array(flat[at:at + n], dtype=np.float32).reshape(shape)
        at += n
    return weights


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES]).astype(np.float32)


def start(shares: np.ndarray) -> Weights:
    """Small random weights, members at zero; the output bias holds the logarithms of the classes' shares."""
    rng = np.random.default_rng(17)
    weights = {name: (rng.standard_normal(shape) * 0.25).astype(np.float32) for name, shape in SHAPES.items() if name != "inner"}
    weights["place"] *= 0.2
    weights["bias"] = np.log(shares).astype(np.float32)
    weights["inner"] = np.zeros(SHAPES["inner"], dtype=np.float32)
    return weights


@dataclass
class Members:
    """The ids of each class: class and row of each id (rows of a class lie together), each class's first row and the end, and by row the logarithm of
    the id's share in its class."""
    of: np.ndarray
    row: np.ndarray
    first: np.ndarray
    prior: np.ndarray


def forward(w: Weights, inputs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(inputs)
    x = w["embed"].take(inputs, axis=0)
    x += w["place"]
    every = x.reshape(-1, WIDTH) @ np.concatenate([w["query"] * np.float32(WIDTH ** -0.5), w["key"], w["value"]], axis=1)
    q, k, v = (np.ascontiguousarray(every[:, i * WIDTH:(i + 1) * WIDTH]).reshape(n, PLACES, WIDTH) for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    _exp(a)
    a *= _SEEN
    a *= np.reciprocal(_sums(a))
    o = a @ v
    y = x + (o.reshape(-1, WIDTH) @ w["mix"]).reshape(n, PLACES, WIDTH)
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "o": o, "y": y}


def _exp(z: np.ndarray) -> np.ndarray:
    """The exponentials of ``z``, in its place; values too large for single precision are bounded."""
    if z.size and z.max() > 60:
        np.minimum(z, 60.0, out=z)
    return np.exp(z, out=z)


def _sums(m: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is kept; a product is faster than a reduction of short rows."""
    return m @ np.ones((m.shape[-1], 1), np.float32)


def _grouped(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts by class, and (class, where it begins, where it ends) of every class that occurs."""
    edges = np.cumsum(np.bincount(classes, minlength=COARSE)).tolist()
    spans = [(c, a, b) for c, (a, b) in enumerate(zip([0, *edges[:-1]], edges, strict=True)) if b > a]
    return np.argsort(classes.astype(np.int8), kind="stable"), spans


def _with_one(y: np.ndarray) -> np.ndarray:
    return np.concatenate([y, np.ones((len(y), 1), np.float32)], axis=1)


def with_prior(w: Weights, members: Members) -> Weights:
    """The weights with the logarithms of shares added to the members' biases."""
    inner = w["inner"].copy()
    inner[:, WIDTH] += members.prior
    return {**w, "inner": inner}


class Scorer:
    """The forward pass with the projections of every id looked up in a table; with one layer only the attention itself is left.

    ``members`` may be left out where classes alone are asked for.
    """

    def __init__(self, w: Weights, members: Members | None = None):
        self.w, self.members = with_prior(w, members) if members else w, members
        across = np.concatenate([np.eye(WIDTH, dtype=np.float32), w["query"] @ w["key"].T * np.float32(WIDTH ** -0.5), w["value"] @ w["mix"]], axis=1)
        self.ids, self.places = w["embed"] @ across, w["place"] @ across

    def hidden(self, inputs: np.ndarray) -> np.ndarray:
        every = self.ids.take(inputs, axis=0)
        every += self.places
        x = np.ascontiguousarray(every[:, :, :WIDTH])
        a = every[:, :, WIDTH:2 * WIDTH] @ x.transpose(0, 2, 1)
        _exp(a)
        a *= _SEEN
        o = a @ every[:, :, 2 * WIDTH:]
        o *= np.reciprocal(_sums(a))
        x += o
        return x

    def _classes(self, y: np.ndarray, targets: np.ndarray) -> np.ndarray:
        z = y @ self.w["out"]
        z += self.w["bias"]
        _exp(z)
        np.maximum(z, 1e-30, out=z)
        return np.log(z[np.arange(len(z)), targets]) - np.log(z @ np.ones(COARSE, np.float32))

    def log_probability(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target class's probability."""
        return self._classes(self.hidden(inputs).reshape(-1, WIDTH), targets.ravel()).reshape(inputs.shape)

    def ids_log_probability(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural logarithm of each scored target id's probability, in the order of np.flatnonzero(scored)."""
        at = np.flatnonzero(scored)
        y, ids = self.hidden(inputs).reshape(-1, WIDTH).take(at, axis=0), targets.ravel().take(at)
        classes = self.members.of[ids]
        out = self._classes(y, classes)
        order, spans = _grouped(classes)
        y, rows, more = _with_one(y).take(order, axis=0), self.members.row[ids[order]], np.zeros(len(out), np.float32)
        for c, begin, end in spans:
            low, high = self.members.first[c:c + 2]
            step = max(1, (1 << 20) // (high - low))
            for a in range(begin, end, step) if high - low > 1 else ():
                b = min(a + step, end)
                z = self.w["inner"][low:high] @ y[a:b].T  # a column for each place
                _exp(z)
                np.maximum(z, 1e-30, out=z)
                more[a:b] = np.log(z[rows[a:b] - low, np.arange(b - a)]) - np.log(z.sum(axis=0))
        out[order] += more
        return out


def _backward(w: Weights, f: dict[str, np.ndarray], inputs: np.ndarray, dy: np.ndarray) -> Weights:
    """Gradients of everything before the output, from the one of the attention's output."""
    n, scale = inputs.shape[0] * PLACES, np.float32(WIDTH ** -0.5)
    rows = lambda m: m.reshape(n, -1)
    do = (rows(dy) @ w["mix"].T).reshape(dy.shape)
    ds = do @ f["v"].transpose(0, 2, 1)
    turned = f["a"].transpose(0, 2, 1)
    dv = turned @ do
    ds -= _sums(do * f["o"])
    ds *= f["a"]
    ds *= scale
    dq, dk = ds @ f["k"], ds.transpose(0, 2, 1) @ f["q"]
    dk *= 1 / scale
    each = np.concatenate([rows(dq), rows(dk), rows(dv)], axis=1)
    flat = rows(dy) + each @ np.concatenate([w["query"], w["key"], w["value"]], axis=1).T
    x = rows(f["x"])
    projected = x.T @ each
    size, places = len(w["embed"]), inputs.ravel()
    embed = np.stack([np.bincount(places, weights=column, minlength=size) for column in np.ascontiguousarray(flat.T)], axis=1)
    return {"embed": embed.astype(np.float32), "place": flat.reshape(dy.shape).sum(axis=0), "query": projected[:, :WIDTH],
            "key": projected[:, WIDTH:2 * WIDTH], "value": projected[:, 2 * WIDTH:], "mix": rows(f["o"]).T @ rows(dy)}


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> Weights:
    """Of the mean negative log probability of classes; ``weight`` is 0 at padded places."""
    f = forward(w, inputs)
    at = np.flatnonzero(weight)
    y = f["y"].reshape(-1, WIDTH).take(at, axis=0)
    grads, dy = _output(w, y, targets.ravel().take(at))
    return grads | _backward(w, f, inputs, _spread(dy, at, f["y"].shape))


def _output(w: Weights, y: np.ndarray, classes: np.ndarray) -> tuple[Weights, np.ndarray]:
    z = y @ w["out"]
    z += w["bias"]
    p = _exp(z)
    p *= np.float32(1 / max(len(p), 1)) / _sums(p)
    p[np.arange(len(p)), classes] -= np.float32(1 / max(len(p), 1))
    return {"out": y.T @ p, "bias": p.sum(axis=0)}, p @ w["out"].T


def _spread(dy: np.ndarray, at: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    every = np.zeros((shape[0] * shape[1], WIDTH), dtype=np.float32)
    every[at] = dy
    return every.reshape(shape)


def inner_gradients(w: Weights, members: Members, y: np.ndarray, ids: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Of the mean negative log probability of ids within their classes: (first row, gradient of its rows) for each class that occurs, and the one of ``y``.
    ``w`` comes with its prior."""
    classes, found = members.of[ids], []
    order, spans = _grouped(classes)
    rows, mine, part = members.row[ids[order]], _with_one(y).take(order, axis=0), np.float32(1 / len(y))
    dy = np.zeros_like(mine)
    for c, a, b in spans:
        low, high = members.first[c:c + 2]
        if high - low > 1:
            vectors, own = w["inner"][low:high], mine[a:b]
            z = vectors @ own.T  # a column for each place
            p = _exp(z)
            p *= part / p.sum(axis=0)
            p[rows[a:b] - low, np.arange(b - a)] -= part
            found.append((low, p @ own))
            np.matmul(p.T, vectors, out=dy[a:b])
    out = np.empty_like(y)
    out[order] = dy[:, :WIDTH]
    return found, out


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of ``lengths`` targets: (text, first place in the text, places that are context only), each target scored once."""
    step = PLACES - OVERLAP
    counts = np.where(lengths <= PLACES, 1, 1 + -(-(lengths - PLACES) // step))
    text = np.repeat(np.arange(len(lengths)), counts)
    order = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, order * step, np.where(order > 0, OVERLAP, 0)


def train(w: Weights, members: Members, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> Weights:
    """One pass over the windows, in a fixed random order: every scored target id is learned. ``embed`` and ``inputs`` may number only the ids that occur."""
    w = {name: value.copy() for name, value in with_prior(w, members).items()}
    first, second = ({name: np.zeros_like(value) for name, value in w.items() if name != "inner"} for _ in range(2))
    inner = np.full_like(w["inner"], 1e-12)
    order = np.random.default_rng(23).permutation(len(inputs))
    for step, low in enumerate(range(0, len(order), BATCH), 1):
        batch = order[low:low + BATCH]
        own = inputs[batch].astype(np.int64)
        f, at = forward(w, own), np.flatnonzero(scored[batch])
        y, ids = f["y"].reshape(-1, WIDTH).take(at, axis=0), targets[batch].ravel().take(at).astype(np.int64)
        grads, dy = _output(w, y, members.of[ids])
        found, more = inner_gradients(w, members, y, ids)
        dy += more
        for row, g in found:
            rows = slice(row, row + len(g))
            inner[rows] += g * g
            w["inner"][rows] -= INNER_RATE * g / np.sqrt(inner[rows])
        for name, g in (grads | _backward(w, f, own, _spread(dy, at, f["y"].shape))).items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.02 * (g * g - second[name])
            w[name] -= RATE * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.98 ** step)) + 1e-6)
    w["inner"][:, WIDTH] -= members.prior
    return w
