"""Territorial consumption analytics as functions from DataFrames to DataFrames."""
