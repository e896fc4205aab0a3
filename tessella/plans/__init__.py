"""Query plans and the registry of queries."""
