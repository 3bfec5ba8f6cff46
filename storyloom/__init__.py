"""Story-graph analytics on Spark: event search, story clustering, reconciliation and corpus work."""

__version__ = "0.1.0"
