"""weftline: collection-completion analytics on Spark DataFrames."""
