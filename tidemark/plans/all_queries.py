"""Importing this registers every query of the engine."""

from tidemark.plans import surface_queries, feature_queries, relational_queries, panel_queries, clock_queries, evidence_queries, registry_queries, selection_queries  # noqa: F401, I001
