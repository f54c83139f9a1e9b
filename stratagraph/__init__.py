"""Graph analytics over code snapshots and text tables, on Spark DataFrames."""
