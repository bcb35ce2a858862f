"""Surveillance-alarm analytics and large-corpus operators on Spark DataFrames."""
