"""Import every module that registers queries."""

from importlib import import_module

MODULES = ("scalars", "analytics", "tables", "visits", "spatial")


def everything():
    for name in MODULES:
        import_module(f"comarca.checks.{name}")
