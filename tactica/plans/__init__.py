"""Registered queries. Importing this package fills the registry."""

from tactica.plans import q_blocks, q_checks, q_eval, q_folds, q_graph, q_misc, q_more, q_seq, q_sessions, q_stats, q_steps  # noqa: F401
from tactica.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
