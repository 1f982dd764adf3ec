"""Pipelines built of the operators, and the catalogue of queries."""
