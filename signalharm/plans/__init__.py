"""Query catalogue over the driver tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``q_*`` module so that its queries register."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
