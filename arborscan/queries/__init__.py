"""All registered queries; importing this package fills the registry."""

from __future__ import annotations

import importlib

from arborscan.queries.registry import ORACLES, QUERIES

MODULES = ["catalogue", "zones", "spatial", "raster", "evaluation", "stream"]

for _module in MODULES:
    importlib.import_module(f"arborscan.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]
