"""tankwise: fleet fuel-telemetry analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions; Python runs on executors only for the isolation forest and the
keyed streaming state.
"""

__version__ = "0.1.0"
