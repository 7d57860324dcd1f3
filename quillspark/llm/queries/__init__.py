"""One module a query: NAME, query(spark, sf_dir) and SQL (None where SQL cannot express it)."""
