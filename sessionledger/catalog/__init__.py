"""All registered queries."""
from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("usage", "guards", "records", "turns", "samples", "fleet", "quota", "sources", "streams"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
