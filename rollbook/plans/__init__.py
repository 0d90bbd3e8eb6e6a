"""Whole jobs: load, page results and reports."""
