"""Work plans, experiments and the registry of queries."""
