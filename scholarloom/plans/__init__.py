"""Multi-step plans, the corpus views over the driver tables and the query registry."""
