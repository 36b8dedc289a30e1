"""Run configurations: variants, guards, fingerprints."""

from __future__ import annotations

import copy
import hashlib
import json
import platform
from collections.abc import Mapping
from typing import Any

#: Sections that say how work is carried out, not what is computed.
OPERATIONAL = ("session", "paths")
# What no variant may change.
CONSTRAINTS = {"learning_rate": 0.001, "batch_size": 4096, "epochs": 100}
# The variants.
VARIANTS: dict[str, dict[str, Any]] = {
    "main": {"search": True},
    "nobo": {"search": False},
    "featall": {"shap": {"feature_set": "all"}},
    "feat20": {"shap": {"feature_set": "top20", "top_k": 20}},
    "mlponly": {"model": {"architecture": "mlp_only"}},
    "cnnonly": {"model": {"architecture": "cnn_only"}},
    "paperlike": {"leakage": {"upsample_before_split": True}, "subsample": {"policy": "none"}},
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with what over says: mappings merge, all else is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else copy.deepcopy(v) for k, v in over.items()}
    return {**copy.deepcopy(dict(base)), **both}


def variant(base: Mapping[str, Any], name: str) -> dict[str, Any]:
    """The configuration of a variant; ValueError if it changes a constraint."""
    if name not in VARIANTS:
        raise KeyError(f"{name!r} is none of {sorted(VARIANTS)}")
    out = merged(base, VARIANTS[name])
    out.setdefault("run", {})["variant"] = name
    check_constraints(out)
    return out


def check_constraints(config: Mapping[str, Any]) -> None:
    training = config.get("training", {})
    bad = {k: training[k] for k, v in CONSTRAINTS.items() if k in training and training[k] != v}
    if bad:
        raise ValueError(f"fixed values are changed: {bad}")


def fingerprint(config: Mapping[str, Any], name: str = "") -> str:
    """Eight hex digits that change with what is computed, not with how."""
    kept = {k: v for k, v in config.items() if k not in OPERATIONAL}
    return hashlib.sha256((json.dumps(kept, sort_keys=True, default=str) + name).encode()).hexdigest()[:8]


def run_record(config: Mapping[str, Any]) -> dict[str, Any]:
    import numpy
    import pyarrow
    import pyspark

    return {"config": fingerprint(config), "constraints": CONSTRAINTS, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__}}
