"""Scalar and list functions."""
