"""Job-counter analytics on Spark.

Cumulative per-job I/O counters, logged as text dumps or exported points, are
read as DataFrames, merged over servers and turned into rates, shares, top
lists, peaks and time series with Spark operators only.
"""

__version__ = "0.1.0"
