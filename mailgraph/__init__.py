"""Message-evidence analytics on Spark DataFrames."""
