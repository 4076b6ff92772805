"""SQL front-end: plain Spark SQL plus the semantic operators."""
