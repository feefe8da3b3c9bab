"""keyloom: keyed relations, declared schemas and key-driven computation on Spark DataFrames."""
