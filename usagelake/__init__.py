"""Usage analytics over coding-agent token records, on Spark."""
