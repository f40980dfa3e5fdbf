"""graphloom: temporal knowledge-graph analytics on Spark DataFrames."""
