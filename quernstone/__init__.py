"""Longitudinal record analytics on Spark DataFrames."""
