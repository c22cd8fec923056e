"""gridweave: utility network plans over terrain, on Spark tables.

The names below are loaded when they are first used.
"""

from __future__ import annotations

import importlib

_WHERE = {
    "plan_batch": "gridweave.plans.planner",
    "run_plan": "gridweave.plans.planner",
    "Planned": "gridweave.plans.planner",
    "PlanRequestError": "gridweave.plans.planner",
    "load": "gridweave.sources.requests",
    "Loaded": "gridweave.sources.requests",
    "read_requests": "gridweave.sources.requests",
    "read_tiff": "gridweave.sources.files",
    "read_vector": "gridweave.sources.files",
    "steiner_input": "gridweave.sources.files",
    "steiner_points": "gridweave.sources.files",
    "cost_raster": "gridweave.operators.raster",
    "least_cost_paths": "gridweave.operators.graphs",
    "shortest_paths": "gridweave.operators.graphs",
    "steiner_tree": "gridweave.operators.graphs",
    "components": "gridweave.operators.components",
    "create_server": "gridweave.plans.service",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(_WHERE[name]), name)
