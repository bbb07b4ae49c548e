"""tidewatch: event-feed analytics as Spark DataFrame / Structured Streaming jobs.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``) function, so the
same code runs on batch tables and on streaming DataFrames.
"""

__version__ = "0.1.0"
