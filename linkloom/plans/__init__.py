"""The registered queries."""

from linkloom.plans import adapting, auditing, dashboards, ingest, linking, matching, reports, rewrites, sources, texts
from linkloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "adapting", "auditing", "dashboards", "ingest", "linking", "matching", "reports", "rewrites", "sources", "texts"]
