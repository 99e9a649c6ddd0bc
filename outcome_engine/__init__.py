"""outcome_engine: outcome analytics for entity tables on Spark."""

__version__ = "0.1.0"
