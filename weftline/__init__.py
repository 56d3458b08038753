"""weftline: level-by-level exploration of graph-shaped data on Spark DataFrames."""
