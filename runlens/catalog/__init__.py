"""Every registered query, grouped by the part of the engine it exercises."""

import importlib

FAMILIES = ("scoring", "ledgers", "loads", "usage", "surfaces", "hosts", "lifecycles", "trust", "fleets", "streams", "reports")


def load():
    """The registry with every family's queries in it."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return importlib.import_module(f"{__name__}.base")
