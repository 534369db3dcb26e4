"""All registered queries."""

import importlib

from kinetable.catalog.registry import QUERIES

for _name in ("paths", "motion", "inference", "latent", "sources", "models", "fits", "structure"):
    importlib.import_module(f"kinetable.catalog.{_name}")

__all__ = ["QUERIES"]
