"""Dataflows made of operators, and the catalog of queries."""
