"""Concord: dataset reconciliation on Spark.

Compare two copies of a dataset, prove whether they are equal, show exactly
where they are not, and repair the difference with an exact undo.
"""

__version__ = "0.1.0"
