"""A Spark-first engine for chunking, retrieving and evaluating text, from DataFrames to DataFrames."""
