"""fleetscope: fleet-wide database-operations telemetry analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from the
DataFrame API, so Catalyst prunes columns, pushes filters into the scan and
AQE picks join strategies and partition counts at run time.
"""

__version__ = "0.1.0"
