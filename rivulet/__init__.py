"""Live tables and derived views on Spark DataFrames."""

__version__ = "0.1.0"
