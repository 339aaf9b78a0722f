"""A typed object-graph query engine that compiles to Spark DataFrames."""
