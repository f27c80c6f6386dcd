"""Continuous variants."""
