"""A document-retrieval analytics engine on Spark DataFrames."""
