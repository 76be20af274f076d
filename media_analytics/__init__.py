"""Spark-native video / channel analytics.

Operators take and return Spark DataFrames; see ``operators``, ``sources``,
``functions``, ``plans`` (registered queries) and ``streaming``.
"""

__version__ = "0.1.0"
