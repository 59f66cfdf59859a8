"""Stores, connectors and inputs."""
