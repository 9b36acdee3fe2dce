"""Operators: functions from DataFrames to DataFrames. Column names are parameters wherever an operator isn't tied to one table."""
