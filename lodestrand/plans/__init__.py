"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that their queries are registered."""
    for found in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{found}")
