"""Scans, reference tables and sinks."""
