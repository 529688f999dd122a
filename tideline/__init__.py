"""Point-in-time ranking and evaluation of append-only market-style data on Spark."""
