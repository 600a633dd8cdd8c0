"""trailmark: build and query a cited corpus of field-protocol text on Spark."""
