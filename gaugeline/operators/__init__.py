"""The models as functions from DataFrames to lazy DataFrames."""
