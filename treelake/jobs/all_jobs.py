"""All registered queries of the core library."""

from treelake.jobs import array_jobs, document_jobs, find_jobs, graph_jobs, rule_jobs, scalar_jobs  # noqa: F401
from treelake.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
