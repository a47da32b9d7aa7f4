"""trilune: multilingual knowledge-graph retrieval analytics on Spark DataFrames."""
