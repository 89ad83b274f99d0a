"""Regime analytics for long multivariate time series on Spark.

Functions take DataFrames and return DataFrames. Rows keep explicit keys: a
``series`` key where a table holds many series, an ``idx`` position inside the
series (see :func:`tidemark.operators.ordering.ordinal`) and a row id.
"""

__version__ = "0.1.0"
