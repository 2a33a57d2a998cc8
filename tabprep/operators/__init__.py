"""Fit/transform operators over whole tables."""
