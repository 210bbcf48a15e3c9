"""Information-theoretic network discovery on Spark DataFrames."""
