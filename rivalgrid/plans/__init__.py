"""Role bindings and registered queries."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every block of queries once."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        if module.startswith("block_"):
            import_module(f"{__name__}.{module}")
