"""Whole jobs: pair scoring, the pair generator, the report and the command line."""
