"""Registered queries: each operator on the driver's tables, with DuckDB SQL for the same rows."""

from tessera.plans import content, layout, reports, tables  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
