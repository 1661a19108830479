"""Operators: functions from DataFrames (and an explicit ``as_of``) to DataFrames."""
