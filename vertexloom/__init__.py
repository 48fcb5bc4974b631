"""Graph-shaped queries over tables, compiled to Spark DataFrames."""
