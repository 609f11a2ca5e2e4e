"""Readers of pages, rules, history and logs."""
