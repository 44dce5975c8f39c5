"""A typed property graph over one triple table, as lazy Spark DataFrames."""
