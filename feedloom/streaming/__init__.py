"""Streams: continuous ingest, deduplication, feed health and features, each equal to its batch form."""
