"""ignis: incident and weather-observation analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the heavy
work (joins, grouping, windows, model fitting) runs on Spark executors and
only report-sized results ever reach the driver.
"""

__version__ = "0.1.0"
