"""pagegrain: page-content analytics and variant evaluation on Spark DataFrames."""

__version__ = "0.1.0"
