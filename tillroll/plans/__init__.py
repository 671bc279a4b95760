"""Multi-step jobs and the registry of queries."""
