"""Registered queries by the ids of the operator inventory, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from cuemill.queries import blocks, clips, files, live, repair, scalars, states, windows
from cuemill.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "blocks", "clips", "files", "live", "repair", "scalars", "states", "windows"]
