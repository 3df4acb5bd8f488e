"""News relevance and token registries on Spark."""
