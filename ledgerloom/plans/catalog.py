"""All ledger queries by name, and their SQL."""

from __future__ import annotations

from . import ledger_keys, order_keys, relation_keys, time_keys, tree_keys, workflow_keys  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
