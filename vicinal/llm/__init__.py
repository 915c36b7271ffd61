"""Operators for preparing training data: deduplication, scoring, tokens, mixing.

Nothing else in the library imports this package. Functions that run in tasks live in its modules, so
executors need the package on their path (`--py-files` or an installed copy).
"""
