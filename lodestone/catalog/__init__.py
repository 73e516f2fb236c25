"""Registered queries: operators bound to the given tables, each with a plain-SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil

from lodestone.catalog import bindings, registry  # noqa: F401


def load_all():
    """Import every module of this package so that its queries register themselves."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry
