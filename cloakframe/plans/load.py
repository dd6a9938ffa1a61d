"""Importing this module fills the catalogue."""

from __future__ import annotations

from cloakframe.plans import rule_queries, score_queries, sink_queries, span_queries, sql_queries  # noqa: F401
from cloakframe.plans.catalog import ORACLES, QUERIES  # noqa: F401
