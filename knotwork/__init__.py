"""knotwork: exact, reproducible facts about graphs and graph collections on Spark."""

__version__ = "0.1.0"
