"""termloom: text search, index analytics and corpus tooling as Spark DataFrame pipelines."""
