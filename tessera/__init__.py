"""Memory and knowledge retrieval on Spark DataFrames."""
