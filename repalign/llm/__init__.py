"""Operators of a training-data pipeline: filtering, deduplication, redaction, archives and token files.

Nothing else in the library imports this subpackage.
"""
