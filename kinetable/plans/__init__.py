"""Compositions of operators and the named queries built from them."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries() -> None:
    """Import every ``queries_*`` module so that it registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
