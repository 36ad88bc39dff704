"""Operators: functions of DataFrames, with every parameter, the present time included, passed in."""
