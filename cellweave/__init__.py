"""Cell-level comparison of tables on Spark."""

__version__ = "0.1.0"
