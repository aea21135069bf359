"""Resampling, windows, features, splits, statistics and metrics as DataFrame transformations."""
