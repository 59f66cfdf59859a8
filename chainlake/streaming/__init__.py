"""Bounded log streams."""
