"""Labelled multi-channel time series on Spark: windows, features, splits, metrics and experiments."""
