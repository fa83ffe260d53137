"""A hybrid-retrieval and indexing engine on Spark DataFrames."""
