"""Scans, stored tables and export sinks."""
