"""Registered queries and their DuckDB twins, one module per family."""

from importlib import import_module
from pkgutil import iter_modules

from catalogops.queries import registry


def registered():
    """The registry after every family has registered its queries."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        import_module(f"{__name__}.{module}")
    return registry
