"""Recordings in, results out."""
