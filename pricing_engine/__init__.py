"""Price-intelligence jobs on Spark: ingest, history, metrics, matching, reports.

Every operator is a function from DataFrames to a DataFrame; paths, dates and
thresholds are parameters.  See README.md for the map of modules.
"""
