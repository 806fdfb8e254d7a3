"""Registered queries: each applies an operator to the driver's tables.

``bindings`` reads the tables in the roles of fields, catalogs, matrices and meshes; the
other modules register queries with the DuckDB SQL that must give the same rows.
"""

from . import chemistry, fields, planes, sources, structures  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
