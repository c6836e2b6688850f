"""Regressors by name: their parameters, defaults, search boxes, and which fits can serve several parameter sets."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

MODEL_TYPES = ("decision_tree", "random_forest", "xgboost", "lasso")

# Default parameters per model.
DEFAULT_PARAMS: dict[str, dict[str, float | None]] = {
    "decision_tree": {"max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8},
    "lasso": {"alpha": 1.0, "max_iter": 1000},
}
# Search bounds of the search over folds.
SEARCH_BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "decision_tree": {"max_depth": (3, 20), "min_samples_split": (2, 20), "min_samples_leaf": (1, 10)},
    "random_forest": {"n_estimators": (50, 200), "max_depth": (3, 20), "min_samples_split": (2, 20), "min_samples_leaf": (1, 10)},
    "xgboost": {
        "n_estimators": (50, 200), "max_depth": (3, 10), "learning_rate": (0.01, 0.3),
        "subsample": (0.6, 1.0), "colsample_bytree": (0.6, 1.0),
    },
    "lasso": {"alpha": (0.001, 10.0)},
}
# Search bounds of the search on validation rows.
VALIDATION_SEARCH_BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "decision_tree": {"max_depth": (2, 20), "min_samples_split": (2, 20), "min_samples_leaf": (1, 20)},
    "random_forest": {"n_estimators": (10, 200), "max_depth": (2, 20), "min_samples_split": (2, 20)},
    "xgboost": {"n_estimators": (10, 200), "max_depth": (2, 10), "learning_rate": (0.01, 0.3)},
    "lasso": {"alpha": (0.001, 10.0), "max_iter": (100, 5000), "tol": (0.0001, 0.01)},
}
# What a request that names no parameters gets.
REQUEST_DEFAULTS: dict[str, dict[str, float | None]] = {
    "decision_tree": {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
    "lasso": {"alpha": 1.0, "max_iter": 1000, "tol": 0.0001},
}
# What a model takes for parameters that neither the caller nor its defaults name.
UNNAMED: dict[str, dict[str, float | None]] = {
    "decision_tree": {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0},
    "lasso": {"alpha": 1.0, "max_iter": 1000, "tol": 0.0001},
}
WHOLE_NUMBERS = {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_iter"}
#: Least allowed values.
LEAST = {
    "n_estimators": 1, "max_depth": 1, "min_samples_split": 2, "min_samples_leaf": 1, "max_iter": 1, "alpha": 0.0, "tol": 0.0, "learning_rate": 0.0,
    "subsample": 0.0, "colsample_bytree": 0.0}
#: Parameters that a larger fit has inside it: it serves every set that differs in these alone.
NESTED = {"decision_tree": ("max_depth", "min_samples_split"), "random_forest": ("n_estimators", "max_depth", "min_samples_split"), "xgboost": ("n_estimators",),
          "lasso": ("alpha", "max_iter", "tol")}
SEED = 42


def whole(params: Mapping[str, float | None]) -> dict[str, float | None]:
    """Cut parameters that count something to whole numbers; a depth of one or less means no limit."""
    out = {k: int(v) if k in WHOLE_NUMBERS and v is not None else v for k, v in params.items()}
    if out.get("max_depth") is not None and out["max_depth"] <= 1:
        out["max_depth"] = None
    return out


@dataclass(frozen=True)
class ModelSpec:
    """A model type with every parameter it takes."""

    model: str
    params: Mapping[str, float | None]

    @property
    def json(self) -> str:
        return json.dumps(dict(self.params), sort_keys=True)

    @property
    def share(self) -> str:
        """Sets with the same share come from one fit."""
        return json.dumps({k: v for k, v in self.params.items() if k not in NESTED[self.model]}, sort_keys=True)


def create_model(model_type: str, params: Mapping[str, float | None] | None = None, defaults: Mapping[str, Mapping] = DEFAULT_PARAMS) -> ModelSpec:
    """A model by name with its defaults filled in."""
    if model_type not in DEFAULT_PARAMS:
        raise ValueError(f"no model type is called {model_type}; there are {', '.join(MODEL_TYPES)}")
    known = UNNAMED[model_type]
    if unknown := sorted({*(params or {})} - {*known}):
        raise ValueError(f"{model_type} has no parameter {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    full = whole({**known, **defaults[model_type], **(params or {})})
    for name, value in full.items():
        if value is None and name != "max_depth" or value is not None and not value >= LEAST[name]:
            raise ValueError(f"{name} is at least {LEAST[name]}, not {value}")
    return ModelSpec(model_type, full)
