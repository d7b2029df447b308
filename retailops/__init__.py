"""retailops: Spark-native retail-operations analytics.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark's own
expressions, joins, aggregates and windows, so one call yields one lazy
Catalyst plan that runs on the executors.  Nothing here collects rows to the
driver.
"""

__version__ = "0.1.0"
