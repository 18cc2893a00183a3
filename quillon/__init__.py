"""quillon: relational, PostgreSQL-flavoured and schema analytics on Spark DataFrames."""
