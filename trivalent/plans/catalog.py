"""Every registered query, and its SQL."""

from trivalent.plans import assembly, audits, behavior, cohort_queries, decisions, evaluation, ledgers, notes, payloads, responses, segmentation, sources, statistics, varied  # noqa: F401
from trivalent.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
