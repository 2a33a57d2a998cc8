"""Scoring of streams with steps that were fitted on a table."""
