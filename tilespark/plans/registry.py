"""The registry the plan modules fill."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tilespark.plans.inputs import Inputs, with_clause


@dataclass(frozen=True)
class Plan:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Inputs], DataFrame]
    sql: str | None

    def query(self, spark, sf_dir):
        return self.run(Inputs(spark, sf_dir))


PLANS: dict[str, Plan] = {}


def plan(name: str, covers: str, sql: str | None = None):
    """Register a plan; ``covers`` lists the inventory ids it answers."""
    def register(fn):
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = Plan(name, tuple(covers.split()), fn, with_clause(sql) if sql else None)
        return fn
    return register
