"""Operators of the reference, by subject. Importing a module registers its operators."""

from importlib import import_module

MODULES = ("policy", "blocks", "calls", "judges", "splits", "match", "translate", "shapes", "lines", "cuts", "measure", "suppress", "stored", "terms", "reports", "audit")


def load_all() -> None:
    for name in MODULES:
        import_module(f"pagegrain.operators.{name}")
