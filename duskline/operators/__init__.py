"""Operators: functions from DataFrames to DataFrames that stay lazy."""
