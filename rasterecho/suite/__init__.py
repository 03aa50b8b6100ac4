"""The registered queries over the given tables."""

from importlib import import_module
from pkgutil import iter_modules


def load():
    """Import every query module and return the filled registry."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
    return import_module(f"{__name__}.registry")
