"""Scans and sinks: driver tables, fixture views, CSV/JSON files, caches."""
