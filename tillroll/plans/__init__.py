"""Whole jobs, from arriving files to stored results."""
