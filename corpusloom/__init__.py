"""corpusloom: web-corpus analytics on Spark DataFrames."""
