"""Operators for preparing training data, as Spark jobs.

Nothing else in ``turnweave`` imports this subpackage.
"""
