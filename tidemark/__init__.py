"""Point-in-time customer features and purchase prediction on Spark DataFrames."""
