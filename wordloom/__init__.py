"""wordloom: transcript alignment, word-error analytics and transcript data preparation on Spark DataFrames."""

__version__ = "0.1.0"
