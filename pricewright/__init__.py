"""Spark-native retail price and demand analytics.

Every operator takes DataFrames and parameters and returns a DataFrame; the work
is left to Catalyst.  See README.md for the map from capability to module.
"""

__version__ = "0.1.0"
