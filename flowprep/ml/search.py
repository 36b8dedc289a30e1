"""A search by a tree-structured Parzen estimator, with pruning at the median, over a small space."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import exp, log
from typing import Any

import numpy as np

#: What may not be searched: these are fixed.
FORBIDDEN = ("learning_rate", "batch_size")


class Pruned(Exception):
    """A trial that was stopped early."""


def check_space(space: Mapping[str, Mapping[str, Any]]) -> None:
    bad = [k for k in space if k in FORBIDDEN]
    if bad:
        raise ValueError(f"{bad} are fixed and can't be searched")
    for k, s in space.items():
        if s["type"] not in ("categorical", "float", "int"):
            raise ValueError(f"{k}: {s['type']!r} is no kind of parameter")


def to_line(s: Mapping[str, Any], v: float) -> float:
    return log(v) if s.get("log") else float(v)


def draw(s: Mapping[str, Any], rng: np.random.Generator) -> Any:
    if s["type"] == "categorical":
        return s["choices"][int(rng.integers(len(s["choices"])))]
    x = rng.uniform(to_line(s, s["low"]), to_line(s, s["high"]))
    x = exp(x) if s.get("log") else x
    return int(round(x)) if s["type"] == "int" else float(x)


def density(s: Mapping[str, Any], seen: list[Any], v: Any) -> float:
    """How likely a value is among those seen, with a uniform prior of the weight of one."""
    if s["type"] == "categorical":
        return (seen.count(v) + 1 / len(s["choices"])) / (len(seen) + 1)
    low, high = to_line(s, s["low"]), to_line(s, s["high"])
    width, x = max((high - low) / max(len(seen), 1) ** 0.5 / 2, 1e-12), to_line(s, v)
    kernels = [exp(-0.5 * ((x - to_line(s, o)) / width) ** 2) / (width * 2.5066) for o in seen]
    return (sum(kernels) + 1 / max(high - low, 1e-12)) / (len(seen) + 1)


def suggest(space: Mapping[str, Mapping[str, Any]], trials: list[dict], number: int, seed: int, warm: int = 5, candidates: int = 24, good_share: float = 0.25) -> dict[str, Any]:
    """The next parameters; they follow from the trials, their number and the seed alone, so a search can be resumed."""
    rng = np.random.default_rng([seed, number])
    done = [t for t in trials if t["state"] == "complete"]
    if len(done) < warm:
        return {k: draw(s, rng) for k, s in space.items()}
    done.sort(key=lambda t: -t["value"])
    cut = max(1, int(np.ceil(good_share * len(done))))
    good, rest = done[:cut], done[cut:]
    out = {}
    for k, s in space.items():
        tried = [draw(s, rng) for _ in range(candidates)] + [t["params"][k] for t in good]
        out[k] = max(tried, key=lambda v: density(s, [t["params"][k] for t in good], v) / density(s, [t["params"][k] for t in rest], v))
    return out


def search(space: Mapping[str, Mapping[str, Any]], objective: Callable[[dict, Callable[[int, float], None]], float], n_trials: int, trials: list[dict] | None = None, seed: int = 0, warmup_steps: int = 3) -> list[dict]:
    """Trials up to n_trials complete or pruned ones, continuing those given; the objective reports (step, value) and is maximised."""
    check_space(space)
    trials = list(trials or [])
    while len(trials) < n_trials:
        number, steps = len(trials), {}
        params = suggest(space, trials, number, seed)

        def report(step: int, value: float, steps: dict = steps) -> None:
            steps[step] = value
            others = [t["steps"][step] for t in trials if t["state"] == "complete" and step in t["steps"]]
            if step >= warmup_steps and others and max(steps.values()) < float(np.median(others)):
                raise Pruned

        try:
            value, state = objective(params, report), "complete"
        except Pruned:
            value, state = max(steps.values()), "pruned"
        trials.append({"number": number, "params": params, "value": value, "state": state, "steps": steps})
    return trials
