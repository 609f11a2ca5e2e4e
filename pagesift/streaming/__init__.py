"""Runs over pages that keep arriving."""
