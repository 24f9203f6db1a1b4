"""A Spark-first engine for point sets, maps and sensor streams held in DataFrames."""
