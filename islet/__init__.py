"""Connected-component analytics over edge tables, on Spark DataFrames."""
