"""riskweave: fraud analytics on Spark DataFrames, SQL and Structured Streaming.

Every operator is a function DataFrame -> DataFrame (or a small set of
DataFrames). Nothing is collected to the driver except one-row statistics
and bounded control tables.
"""

__version__ = "0.1.0"
