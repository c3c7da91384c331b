"""Content-feed analytics on Spark: ingestion, feed health, item queries, text features and related items."""
