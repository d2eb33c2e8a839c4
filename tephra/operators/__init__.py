"""Operators: functions from DataFrames to DataFrames, each over many series at once (`by` names their keys)."""
