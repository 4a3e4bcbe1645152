"""pactlens: contract analytics and trust-and-safety on Spark DataFrames."""

__version__ = "0.1.0"
