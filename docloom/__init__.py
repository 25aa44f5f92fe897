"""docloom: document intelligence on Spark DataFrames."""
