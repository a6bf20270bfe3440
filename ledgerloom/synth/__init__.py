"""Deterministic generators of test scenarios."""
