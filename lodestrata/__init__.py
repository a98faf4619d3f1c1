"""lodestrata: a Spark-native engine for code, text, graph, vector and event-log analytics."""

__version__ = "0.1.0"
