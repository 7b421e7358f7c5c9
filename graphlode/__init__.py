"""graphlode: vector-graph analytics and corpus preparation expressed as Spark DataFrames."""
