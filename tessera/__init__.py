"""tessera: graph-retrieval analytics on Spark DataFrames."""
