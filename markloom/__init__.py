"""markloom: keyword-graph analytics over text, written as plain PySpark jobs."""
