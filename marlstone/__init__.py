"""A governed analytics engine on Spark SQL and DataFrames."""
