"""Continuous forms of the incremental operators."""
