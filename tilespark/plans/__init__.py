"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from tilespark.plans.registry import PLANS, Plan

_AREAS = ("keys", "coverage", "density", "cache", "routing", "requests", "raster", "mesh", "stack", "vector", "describe", "files", "streams")


def load() -> dict[str, Plan]:
    for area in _AREAS:
        import_module(f"tilespark.plans.{area}_plans")
    return PLANS
