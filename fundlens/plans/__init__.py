"""Operators wired into whole queries."""
