"""Training-data operators: one module for each operator, all on Spark DataFrames.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
