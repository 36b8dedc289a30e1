"""A small network of a convolution branch and a dense branch, in numpy: forward, backward, Adam.

Features are a grid: one row of K in conv1d mode, nearly square in conv2d_reshape mode. Both branches end in a dense
layer, are laid side by side, and pass a fusion layer, dropout and a single logit. A pool is left out where a side of
the grid is shorter than 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# The choices.
ARCHITECTURES = ("cnn_mlp", "mlp_only", "cnn_only")
MODES = ("conv1d", "conv2d_reshape")
ACTIVATIONS = ("relu", "tanh", "elu")


@dataclass
class Shape:
    """The sizes of a network."""

    n_features: int
    architecture: str = "cnn_mlp"
    conv_mode: str = "conv1d"
    cnn_filters_1: int = 32
    cnn_filters_2: int = 64
    cnn_kernel_size: int = 3
    cnn_dense: int = 128
    mlp_units_1: int = 128
    mlp_units_2: int = 64
    fusion_dim: int = 128
    dropout: float = 0.2
    activation: str = "relu"
    notes: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for value, known in ((self.architecture, ARCHITECTURES), (self.conv_mode, MODES), (self.activation, ACTIVATIONS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")
        if self.n_features < 1 or not 0 <= self.dropout < 1:
            raise ValueError("there must be features, and dropout must be in [0, 1)")

    def grid(self) -> tuple[int, int]:
        if self.conv_mode == "conv1d":
            return 1, self.n_features
        high = int(np.ceil(np.sqrt(self.n_features)))
        return high, -(-self.n_features // high)

    def pools(self) -> list[tuple[int, int]]:
        """The windows of the two pools; (1, 1) is none."""
        high, wide = self.grid()
        out = []
        for i in (1, 2):
            window = (1, 2) if self.conv_mode == "conv1d" else (2, 2)
            if high < window[0] or wide < window[1]:
                self.notes.append(f"pool {i} is left out: the grid is {high} x {wide}")
                window = (1, 1)
            high, wide = high // window[0], wide // window[1]
            out.append(window)
        return out


def act(name: str, x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) if name == "relu" else np.tanh(x) if name == "tanh" else np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def act_slope(name: str, x: np.ndarray) -> np.ndarray:
    return (x > 0).astype(x.dtype) if name == "relu" else 1 - np.tanh(x) ** 2 if name == "tanh" else np.where(x > 0, 1, np.exp(np.minimum(x, 0)))


class Net:
    def __init__(self, shape: Shape, seed: int = 0):
        self.shape = shape
        self.kernel = (1, shape.cnn_kernel_size) if shape.conv_mode == "conv1d" else (shape.cnn_kernel_size,) * 2
        self.pools = shape.pools()
        high, wide = shape.grid()
        for a, b in self.pools:
            high, wide = high // a, wide // b
        taps = self.kernel[0] * self.kernel[1]
        sizes: dict[str, tuple[int, int]] = {}
        joint = 0
        if shape.architecture != "mlp_only":
            sizes |= {"conv1": (taps, shape.cnn_filters_1), "conv2": (taps * shape.cnn_filters_1, shape.cnn_filters_2), "flat": (high * wide * shape.cnn_filters_2, shape.cnn_dense)}
            joint += shape.cnn_dense
        if shape.architecture != "cnn_only":
            sizes |= {"mlp1": (shape.n_features, shape.mlp_units_1), "mlp2": (shape.mlp_units_1, shape.mlp_units_2)}
            joint += shape.mlp_units_2
        sizes |= {"fusion": (joint, shape.fusion_dim), "logit": (shape.fusion_dim, 1)}
        rng = np.random.default_rng(seed)
        self.weights: dict[str, np.ndarray] = {}
        for name, (n, m) in sizes.items():
            bound = 1 / np.sqrt(n)
            self.weights[f"{name}.w"] = rng.uniform(-bound, bound, (n, m))
            self.weights[f"{name}.b"] = rng.uniform(-bound, bound, m)

    def n_parameters(self) -> int:
        return sum(w.size for w in self.weights.values())

    def _dense(self, name: str, x: np.ndarray, tape: list, active: bool = True) -> np.ndarray:
        z = x @ self.weights[f"{name}.w"] + self.weights[f"{name}.b"]
        tape.append(("dense", name, x, z, active))
        return act(self.shape.activation, z) if active else z

    def _conv(self, name: str, x: np.ndarray, tape: list) -> np.ndarray:
        a, b = self.kernel
        padded = np.pad(x, ((0, 0), ((a - 1) // 2, a // 2), ((b - 1) // 2, b // 2), (0, 0)))
        view = np.lib.stride_tricks.sliding_window_view(padded, (a, b), axis=(1, 2))  # rows, high, wide, channels, a, b
        columns = view.transpose(0, 1, 2, 4, 5, 3).reshape(*x.shape[:3], -1)
        z = columns @ self.weights[f"{name}.w"] + self.weights[f"{name}.b"]
        tape.append(("conv", name, columns, z, x.shape))
        return act(self.shape.activation, z)

    @staticmethod
    def _pool(x: np.ndarray, window: tuple[int, int], tape: list) -> np.ndarray:
        a, b = window
        if window == (1, 1):
            return x
        n, high, wide, c = x.shape
        blocks = x[:, : high // a * a, : wide // b * b].reshape(n, high // a, a, wide // b, b, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, high // a, wide // b, c, a * b)
        at = blocks.argmax(axis=-1)
        tape.append(("pool", window, x.shape, at))
        return np.take_along_axis(blocks, at[..., None], axis=-1)[..., 0]

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, dict]:
        """Logits, and what backward() needs; dropout is active only with a generator."""
        s, tapes, parts = self.shape, {"cnn": [], "mlp": [], "joint": []}, []
        if s.architecture != "mlp_only":
            high, wide = s.grid()
            g = np.zeros((len(x), high * wide))
            g[:, : s.n_features] = x
            t = tapes["cnn"]
            g = self._pool(self._conv("conv1", g.reshape(-1, high, wide, 1), t), self.pools[0], t)
            g = self._pool(self._conv("conv2", g, t), self.pools[1], t)
            t.append(("flatten", g.shape))
            parts.append(self._dense("flat", g.reshape(len(x), -1), t))
        if s.architecture != "cnn_only":
            parts.append(self._dense("mlp2", self._dense("mlp1", x, tapes["mlp"]), tapes["mlp"]))
        tapes["widths"] = [p.shape[1] for p in parts]
        h = self._dense("fusion", np.concatenate(parts, axis=1), tapes["joint"])
        if rng is not None and s.dropout:
            mask = (rng.random(h.shape) >= s.dropout) / (1 - s.dropout)
            tapes["joint"].append(("mask", mask))
            h = h * mask
        return self._dense("logit", h, tapes["joint"], False)[:, 0], tapes

    def _back(self, tape: list, g: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        for entry in reversed(tape):
            if entry[0] == "dense":
                _, name, x, z, active = entry
                g = g * act_slope(self.shape.activation, z) if active else g
                grads[f"{name}.w"], grads[f"{name}.b"] = x.T @ g, g.sum(axis=0)
                g = g @ self.weights[f"{name}.w"].T
            elif entry[0] == "mask":
                g = g * entry[1]
            elif entry[0] == "flatten":
                g = g.reshape(entry[1])
            elif entry[0] == "pool":
                _, (a, b), (n, high, wide, c), at = entry
                blocks = np.zeros((*at.shape, a * b))
                np.put_along_axis(blocks, at[..., None], g[..., None], axis=-1)
                full = np.zeros((n, high, wide, c))
                full[:, : high // a * a, : wide // b * b] = blocks.reshape(n, high // a, wide // b, c, a, b).transpose(0, 1, 4, 2, 5, 3).reshape(n, high // a * a, wide // b * b, c)
                g = full
            else:
                _, name, columns, z, (n, high, wide, c) = entry
                a, b = self.kernel
                g = g * act_slope(self.shape.activation, z)
                grads[f"{name}.w"], grads[f"{name}.b"] = np.tensordot(columns, g, axes=([0, 1, 2], [0, 1, 2])), g.sum(axis=(0, 1, 2))
                taps = (g @ self.weights[f"{name}.w"].T).reshape(n, high, wide, a, b, c)
                padded = np.zeros((n, high + a - 1, wide + b - 1, c))
                for i in range(a):
                    for j in range(b):
                        padded[:, i : i + high, j : j + wide] += taps[:, :, :, i, j]
                g = padded[:, (a - 1) // 2 : (a - 1) // 2 + high, (b - 1) // 2 : (b - 1) // 2 + wide]
        return g

    def backward(self, tapes: dict, g: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the inputs, from those of the logits."""
        grads: dict[str, np.ndarray] = {}
        joint = self._back(tapes["joint"], g[:, None], grads)
        out, at = 0, 0
        for branch, n in zip([b for b in ("cnn", "mlp") if tapes[b]], tapes["widths"], strict=True):
            below = self._back(tapes[branch], joint[:, at : at + n], grads)
            out = out + below.reshape(len(below), -1)[:, : self.shape.n_features]
            at += n
        return grads, out


def loss_and_slope(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy of logits, and its gradient."""
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    return float(loss.mean()), (1 / (1 + np.exp(-z)) - y) / len(z)


@dataclass
class Adam:
    rate: float = 0.001
    decay: float = 0.0
    step: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def update(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            g = g + self.decay * weights[k]
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            v = self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            weights[k] = weights[k] - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def epochs(net: Net, opt: Adam, x: np.ndarray, y: np.ndarray, first: int, last: int, batch: int = 4096, seed: int = 0) -> Iterator[tuple[int, float]]:
    """Train from epoch first to last; all that is random follows from the epoch's number, so a run that is resumed gives the same weights."""
    for epoch in range(first, last + 1):
        rng = np.random.default_rng([seed, epoch])
        order, total = rng.permutation(len(x)), 0.0
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            z, tapes = net.forward(x[rows], rng)
            loss, slope = loss_and_slope(z, y[rows])
            opt.update(net.weights, net.backward(tapes, slope)[0])
            total += loss * len(rows)
        yield epoch, total / len(x)


def expected_gradients(net: Net, rows: np.ndarray, background: np.ndarray, draws: int = 32, seed: int = 0) -> np.ndarray:
    """Attributions of the logit: gradients along random paths from random background rows."""
    out = np.zeros_like(rows)
    for k in range(draws):
        rng = np.random.default_rng([seed, k])
        base = background[rng.integers(0, len(background), len(rows))]
        at = base + rng.random((len(rows), 1)) * (rows - base)
        _, tapes = net.forward(at)
        out += net.backward(tapes, np.ones(len(rows)))[1] * (rows - base)
    return out / draws
