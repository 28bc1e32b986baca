"""factorloom: cross-sectional equity factor research on Spark DataFrames."""

__version__ = "0.1.0"
