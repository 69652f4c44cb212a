"""Layout, table, transcript and document operators on Spark DataFrames."""
