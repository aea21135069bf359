"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage; the registry at the
repository top adds its queries only when it is present.
"""
