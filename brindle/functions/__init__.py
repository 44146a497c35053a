"""Scalar and aggregate function surface."""
