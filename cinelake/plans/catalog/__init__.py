"""Driver-table forms of the operators, one module per family."""

import importlib

FAMILIES = ("scans", "identification", "containers", "audio", "frames", "conformance")


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"cinelake.plans.catalog.{family}")
