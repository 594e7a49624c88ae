"""Change-data-capture analytics on Spark."""
