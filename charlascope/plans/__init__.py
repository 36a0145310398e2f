"""Whole pipelines built from the operators, and the queries the entry point registers."""
