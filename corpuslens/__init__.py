"""corpuslens: content consolidation analytics on Spark DataFrames."""
