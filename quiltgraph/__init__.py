"""Property-graph analytics on Spark: schema, graph query compiler, analyses, ingest and stores."""
