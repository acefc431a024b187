"""Evidence assessment and review routing on Spark DataFrames."""

__version__ = "0.1.0"
