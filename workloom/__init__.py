"""workloom: query-workload analytics as plain Spark DataFrame jobs."""
