"""Reading snapshots and change logs, and writing events and tables."""
