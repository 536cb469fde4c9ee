"""Every query of the engine by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import building, integrity, metrics, pools, rendered, tables  # noqa: F401  (they enter their queries)
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
