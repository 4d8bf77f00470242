"""Security-operations analytics as Spark jobs.

Every operator takes DataFrames and returns DataFrames; nothing here starts a
session by itself except :mod:`duskwatch.session`.
"""

__version__ = "0.1.0"
