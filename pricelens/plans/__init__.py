"""Views over the driver's tables and the registered query catalogue."""

from __future__ import annotations

import importlib

from .registry import REGISTRY

_MODULES = ["q_market", "q_clean", "q_profile", "q_features", "q_model", "q_pipeline"]


def load_all() -> dict:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
