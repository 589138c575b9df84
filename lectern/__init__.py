"""Document retrieval, usage analytics and event streams as Spark jobs."""
